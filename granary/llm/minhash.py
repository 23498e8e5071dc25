"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, parts, table
from granary.llm.components import connected_components

#: Linked are documents with 100 * intersection >= PERCENT * union of their sets of WORDS-word shingles.
WORDS, PERCENT = 3, 85
#: Two sets of similarity 0.85 meet in none of the bands with probability (1 - 0.85^5)^25, under 1e-6.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Signatures are compared in batches of so many hashes; a pair is dropped once its posterior chance of being similar enough is under MISS.
BATCH, MISS = 25, 1e-6
#: Up to this many documents of a band's bucket are compared pair by pair; of larger ones each document is compared with
#: the bucket's leader, and then those that this leaves apart with all of the leader's buckets, in blocks.
SMALL_BUCKET = 12
#: A block's bounds: rows, and bytes of what tells its sets from the leader's.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
WORD_CACHE = 60_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SHIFT = np.uint64(31)

_words: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z in lower case: what lies between ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending; of the whole sequence if it is shorter than a shingle."""
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * _MIX[k % 3]
        mixed ^= mixed >> _SHIFT
    mixed *= _MIX[3]
    mixed ^= mixed >> _SHIFT
    return np.unique(mixed * _MIX[4])


def bands_for(percent: int) -> int:
    """As many bands as miss a pair of that similarity with no greater chance than BANDS miss one of PERCENT."""
    never = lambda p: math.log1p(-((p / 100) ** ROWS))
    return BANDS if percent == PERCENT else math.ceil(BANDS * never(PERCENT) / never(percent))


@functools.cache
def _hashing(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, hashes, np.uint64)


def minima(own: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    least = np.full(hashes, 0xFFFFFFFF, np.uint64)
    a, b = _hashing(hashes)
    for lo in range(0, len(own), 2048):
        h = (a[:, None] * own[None, lo : lo + 2048] + b[:, None]) >> np.uint64(32)
        least = np.minimum(least, h.min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _MIX[0]
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _MIX[1]
        key ^= key >> _SHIFT
    return (key * _MIX[3]).view(np.int64)


@functools.cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Of n compared hashes of 8 bits, so many must agree for a posterior chance of at least `miss` (from a flat prior) that the sets are similar enough."""
    p = percent / 100 + (1 - percent / 100) / 256
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)  # the regularized beta function at whole numbers
        if below >= miss:
            return m
    return n


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets have at least `percent` hundredths of their union in common."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 500):
        n, content, signature, bands = [], [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            own = shingles(words, width)
            n.append(len(own))
            least = minima(own, hashes) if len(own) else None
            content.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            signature.append(None if least is None else (least & np.uint64(255)).astype(np.uint8).tobytes())
            bands.append(None if least is None else band_keys(least))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "content", "signature", "bands"])


def _signatures(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, hashes)


def _survivors(one: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures (one may stand for all rows), the rows that no batch of hashes rules out, and how many of their hashes agree."""
    hashes = other.shape[1]
    left, agree = np.arange(len(other)), np.zeros(len(other), np.int64)
    for lo in range(0, hashes, BATCH):
        own = one[lo : lo + BATCH] if one.ndim == 1 else one[left, lo : lo + BATCH]
        agree = agree + (own == other[left, lo : lo + BATCH]).sum(1)
        on = agree >= least_matches(min(lo + BATCH, hashes), percent)
        left, agree = left[on], agree[on]
    return left, agree


def _prune(batches: Iterator[pa.RecordBatch], percent: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures don't rule out that they are similar enough."""
    for batch in parts(batches, 5000):
        if batch.num_rows:
            left, _ = _survivors(_signatures(batch.column(2), hashes), _signatures(batch.column(3), hashes), percent)
            yield batch.select(["a", "b"]).take(pa.array(left))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose text has the wanted content."""
    for batch in parts(batches, 500):
        ids, sets = [], []
        for doc_id, text, content in zip(*(batch.column(k) for k in range(3)), strict=True):
            words = words_of(text.as_py())
            if words and xxhash.xxh3_128_digest(b" ".join(words)) == content.as_py():
                ids.append(doc_id.as_py())
                sets.append(shingles(words, width).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "own"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1000):
        found = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def _differ(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (rep, leader, own set, the leader's set): whether the two are linked, the size of the leader's set, what own lacks of it and what it has beside it."""
    for batch in parts(batches, 500):
        linked, size, lacks, has = [], [], [], []
        for own, lead in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(lead.as_buffer(), np.uint64)
            linked.append(similar(x, y, percent))
            size.append(len(y))
            lacks.append(np.setdiff1d(y, x, True).tobytes())
            has.append(np.setdiff1d(x, y, True).tobytes())
        own = [pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(lacks, pa.binary()), pa.array(has, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own], ["rep", "leader", "linked", "size", "lacks", "has"])


class _Postings:
    """Which rows of a block hold a value."""

    def __init__(self, sets: list[np.ndarray]):
        self.rows = len(sets)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owners = np.repeat(np.arange(self.rows), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many values each row has in common with own."""
        lo, hi = np.searchsorted(self.values, own), np.searchsorted(self.values, own, "right")
        met = [self.owners[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True) if i < j]
        return np.bincount(np.concatenate(met), minlength=self.rows) if met else np.zeros(self.rows, np.int64)


def _block_links(rows, percent: int, hashes: int):
    """Links between parts that are still apart, of rows with `asks` to all rows of a block: a forest over the parts, so never more than there are rows.

    Sets are known by what they lack of the leader's set and what they have beside it, from which intersections follow exactly.
    """
    import pandas as pd

    every, asks = rows[~rows["asks"]], rows[rows["asks"]]
    of = lambda x, name: [np.frombuffer(v, np.uint64) for v in x[name]]
    lacks, has = of(every, "lacks"), of(every, "has")
    posted = _Postings(lacks), _Postings(has)
    n_lacks, n_has = np.array([len(x) for x in lacks], np.int64), np.array([len(x) for x in has], np.int64)
    ids, sig = every["rep"].to_numpy(), np.frombuffer(b"".join(every["signature"]), np.uint8).reshape(-1, hashes)
    part, own_part = every["part"].to_numpy().copy(), asks["part"].to_numpy().copy()
    links = []
    for i, (rep, signature, size, out, extra) in enumerate(zip(asks["rep"], asks["signature"], asks["size"], of(asks, "lacks"), of(asks, "has"), strict=True)):
        on = np.flatnonzero(part != own_part[i])
        left, agree = _survivors(np.frombuffer(signature, np.uint8), sig[on], percent)
        if not len(left):
            continue
        on = on[left[np.argsort(-agree, kind="stable")]]
        both = size - len(out) - n_lacks[on] + posted[0].shared(out)[on] + posted[1].shared(extra)[on]
        union = 2 * size - len(out) - n_lacks[on] + len(extra) + n_has[on] - both
        for j in on[100 * both >= percent * union].tolist():
            if part[j] != own_part[i]:
                links.append((rep, int(ids[j])))
                old, new = part[j], own_part[i]
                part[part == old] = new
                own_part[own_part == old] = new
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; linked by shingles of `width` words, from `percent` hundredths on.

    Documents with the same words are one representative first, by a grouping that Spark combines before the shuffle,
    so copies never meet as pairs. Representatives in small buckets of a band are compared in pairs. Of a larger bucket
    each one is compared with the bucket's leader, which mostly joins all but a few; those that it leaves apart are
    compared, in blocks of bounded bytes, with all of the leader's buckets, knowing of each set only what tells it from
    the leader's. Of a block's links only such as join parts leave it, so a group of n costs no n * n rows. What
    signatures don't rule out is confirmed on the full sets. Nothing is capped.

    Null and empty texts, and texts without words, have an empty set and are their own component; so are rows without a
    doc_id, whose component_id is null and which are kept. Rows that repeat a doc_id get equal results. Other columns
    are ignored; an empty table gives an empty result.
    """
    hashes = bands_for(percent) * ROWS
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(lambda batches: _sketch(batches, width, hashes), "doc_id long, n_shingles long, content binary, signature binary, bands array<long>"), "sketch")
    known = sketch.where("content is not null and doc_id is not null")
    first = known.groupBy("content").agg(F.min(F.struct("doc_id", "signature", "bands")).alias("first"), F.count("*").alias("n"))
    reps = materialize(first.select("content", "n", F.col("first.doc_id").alias("rep"), F.xxhash64("first.doc_id").alias("place"), "first.signature", "first.bands"), "reps")

    # of a bucket the leader is the first in the order of a hash that is one-to-one, so buckets that share members mostly share it
    members = reps.select("rep", "place", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("place").alias("lead")).where("n > 1")
    members = materialize(members.join(shared, "bucket").select("bucket", "n", "lead", "rep", "place"), "members")

    small = members.where(F.col("n") <= SMALL_BUCKET).select("bucket", "rep")
    pairs = small.select("bucket", F.col("rep").alias("a")).join(small.select("bucket", F.col("rep").alias("b")), "bucket").where("a < b").select("a", "b").distinct()
    signed = reps.select("rep", "signature")
    with_a = pairs.join(signed.select(F.col("rep").alias("a"), F.col("signature").alias("x")), "a")
    with_b = with_a.join(signed.select(F.col("rep").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y")
    pairs = materialize(with_b.mapInArrow(lambda batches: _prune(batches, percent, hashes), "a long, b long"), "pairs")
    led = members.where(F.col("n") > SMALL_BUCKET).select("rep", "place", "lead").distinct()
    led = materialize(led.join(reps.select(F.col("rep").alias("leader"), F.col("place").alias("lead")), "lead").select("rep", "leader"), "led")

    candidates = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(led.select("rep")).distinct()
    wanted = candidates.join(reps.select("rep", "content"), "rep")
    sets = materialize(docs.join(wanted, docs.doc_id == wanted.rep).select("rep", "text", "content").mapInArrow(lambda batches: _sets(batches, width), "rep long, own binary"), "sets")

    with_lead = led.join(sets, "rep").join(sets.select(F.col("rep").alias("leader"), F.col("own").alias("lead")), "leader").select("rep", "leader", "own", "lead")
    differ = materialize(with_lead.mapInArrow(lambda batches: _differ(batches, percent), "rep long, leader long, linked boolean, size long, lacks binary, has binary"), "differ")
    led_by = connected_components(differ.where("linked and rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    apart = _apart(differ, led_by, signed, percent, hashes)

    # of the pairs, those count that no leader has joined
    part = lambda x: led_by.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
    pairs = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left").where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    links = with_b.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")
    links = links.union(apart).union(led_by.where("node <> component").select("node", "component"))
    return _placed(sketch, reps, connected_components(links))


def _apart(differ: DataFrame, components: DataFrame, signed: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Links that join parts which the links so far leave apart inside the buckets of one leader."""
    rows = differ.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component", "linked")
    by_part = rows.groupBy("leader", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("lacks") + F.octet_length("has")).alias("bytes"))
    groups = by_part.groupBy("leader").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"), F.sum("bytes").alias("bytes")).where("parts > 1")
    share = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil((F.col("bytes") + F.col("n") * hashes) / BLOCK_BYTES))
    groups = groups.select("leader", "most", share.cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(share * F.col("others") / F.col("n"))).cast("int").alias("asking"))
    rows = rows.join(groups, "leader").join(signed, "rep")
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one_side = rows.withColumn("i", of("blocks")).withColumn("j", F.explode(every("asking"))).withColumn("asks", F.lit(False))
    other_side = rows.where("part <> most").withColumn("j", of("asking")).withColumn("i", F.explode(every("blocks"))).withColumn("asks", F.lit(True))
    dealt = one_side.select("leader", "i", "j", "asks", "rep", "part", "size", "lacks", "has", "signature").unionByName(other_side.select("leader", "i", "j", "asks", "rep", "part", "size", "lacks", "has", "signature"))
    return materialize(dealt.groupBy("leader", "i", "j").applyInPandas(lambda rows: _block_links(rows, percent, hashes), "a long, b long"), "apart")


def _placed(sketch: DataFrame, reps: DataFrame, components: DataFrame) -> DataFrame:
    """The result's row of every sketch; rows without words or id, which nothing links, are no part of the joins."""
    copies = reps.where("n > 1").select("content", F.col("rep").alias("_rep"))
    alone = F.col("content").isNull() | F.col("doc_id").isNull()
    placed = sketch.where(~alone).select("doc_id", "n_shingles", "content").join(copies, "content", "left").withColumn("_node", F.coalesce("_rep", "doc_id"))
    placed = placed.join(components.withColumnRenamed("node", "_node"), "_node", "left")
    out = placed.select("doc_id", "n_shingles", F.coalesce("component", "_node").alias("component_id"))
    out = out.unionByName(sketch.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select doc_id, case when len(w) >= {WORDS} then list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
), n as (select doc_id, len(s)::bigint as n from s), f as (select doc_id, unnest(s) as g from s),
links as (
    select x.a, x.b from (select a.doc_id as a, b.doc_id as b, count(*) as shared from f a join f b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2) x
    join n p on p.doc_id = x.a join n q on q.doc_id = x.b where 100 * shared >= {PERCENT} * (p.n + q.n - shared)
), reach(a, b) as (
    select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), best as (select a, least(a, min(b)) as c from reach group by a)
select n.doc_id, n.n as n_shingles, coalesce(best.c, n.doc_id) as component_id, coalesce(best.c, n.doc_id) = n.doc_id as kept from n left join best on best.a = n.doc_id
"""
