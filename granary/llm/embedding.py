"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, parts, table
from granary.llm.components import connected_components

THRESHOLD = 0.93
#: Codebooks are fitted on this many vectors at most, the first in the order of a hash; every vector is indexed.
SAMPLE = 20_000
#: Of neighbours at the very threshold, the share that the traversal is to reach; nearer ones are reached more often.
TARGET_RECALL = 0.995
#: Vectors of the index and queries of a block, and their bytes; a larger area is split into blocks. So many links, as bits of a matrix, are looked at at once.
INDEX_BLOCK, QUERY_BLOCK, INDEX_BYTES, QUERY_BYTES = 16_384, 65_536, 8 << 20, 24 << 20
MATRIX = 16 << 20
#: Codebooks have the fourth root of the number of vectors as words, so cells have about as many vectors each as there are words; at most so many.
MOST_WORDS = 256


class MultiIndex:
    """Two codebooks, for the halves of unit vectors; their product is the grid of cells."""

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, target: float = TARGET_RECALL, words: int = 16, rounds: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.half, self.radius2 = sample.shape[1] // 2, 2 - 2 * threshold
        self.books = [self._fit(x, words, rounds, rng) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.gaps = [np.maximum(np.sqrt(self._far(b, b)), 1e-12) for b in self.books]
        self.most = self.books[0].shape[0] * self.books[1].shape[0]
        if len(sample):
            self.most = self._calibrate(sample[rng.integers(0, len(sample), 4000)], threshold, target, rng)
        self.ranks = self._ranks()

    @staticmethod
    def _far(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None], 0)

    def _fit(self, x: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
        distinct = np.unique(x, axis=0) if len(x) else np.zeros((1, x.shape[1]))
        book = distinct[rng.permutation(len(distinct))[:words]].copy()
        for _ in range(rounds):
            near = self._far(x, book).argmin(1)
            for k in range(len(book)):
                if (own := x[near == k]).size:
                    book[k] = own.mean(0)
        return book

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._far(x[:, : self.half], self.books[0]), self._far(x[:, self.half :], self.books[1])

    def _calibrate(self, queries: np.ndarray, threshold: float, target: float, rng: np.random.Generator) -> int:
        """How many cells, nearest first, hold a neighbour at the threshold with the target probability: measured on random such neighbours."""
        away = rng.standard_normal(queries.shape)
        away -= (away * queries).sum(1)[:, None] * queries
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
        i, j = self.cells(threshold * queries + np.sqrt(1 - threshold**2) * away)
        one, two = self._halves(queries)
        before = []
        for a, b, p, q in zip(one, np.sort(two, 1), i, j, strict=True):
            at = a[p] + two[len(before), q]
            before.append(int(np.searchsorted(b, at - a).sum()))  # for each word of the first half, the words of the second that come earlier
        return min(self.most, int(np.quantile(before, target)) + 1)

    def _ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places in the two sorted sequences that can be among the first `most` cells: before (r, s) come r * s + r + s others."""
        words = [len(b) for b in self.books]
        pairs = [(r, s) for r in range(words[0]) for s in range(min(words[1], self.most // (r + 1)))]
        return tuple(np.array(x) for x in zip(*pairs, strict=True))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self._halves(x)
        return one.argmin(1), two.argmin(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, word of the first half, word of the second) of all cells that the traversals of the vectors visit.

        Both halves' words are sorted by their distance; cells come by rising sum of two squared distances, along the
        two sorted sequences, until as many are visited as the target recall needs. Cells that the triangle inequality
        shows to hold no neighbour are passed over.
        """
        r, s = self.ranks
        sums, bounds, order = np.zeros((len(x), len(r))), np.zeros((len(x), len(r))), []
        for far, gaps, place in zip(self._halves(x), self.gaps, (r, s), strict=True):
            near = np.argsort(far, 1, kind="stable")
            far = np.take_along_axis(far, near, 1)
            beyond = np.maximum(0, (far - far[:, :1]) / (2 * gaps[near[:, :1], near]))
            beyond[:, 0] = 0
            sums += far[:, place]
            bounds += beyond[:, place] ** 2
            order.append(near)
        on = bounds <= self.radius2 + 1e-9
        if len(x) and self.most < len(r):
            on &= sums <= np.partition(sums, self.most - 1, axis=1)[:, self.most - 1 : self.most]
        who, cell = np.nonzero(on)
        return who, order[0][who, r[cell]], order[1][who, s[cell]]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.maximum(np.abs(v).max(1), 1e-300)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        own = np.asarray(x.values)
        out[k, : len(own)] = own
    return out


class Grid:
    """The cells of the product grid, joined to areas of about as many vectors as a block holds: neighbouring cells, or one alone."""

    def __init__(self, index: MultiIndex, counts: np.ndarray, most: int):
        first = index.books[0]
        axis = np.linalg.svd(first - first.mean(0), full_matrices=False)[2][0] if len(first) > 1 else np.zeros(first.shape[1])
        area = held = at = 0
        self.area, self.place = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
        self.cells = 0  # the most that an area has
        for i in np.argsort(first @ axis, kind="stable"):  # words that are near each other mostly follow each other
            for j in range(counts.shape[1]):
                if held and held + counts[i, j] > most:
                    area, held, at = area + 1, 0, 0
                self.area[i, j], self.place[i, j] = area, at
                at, held = at + 1, held + int(counts[i, j])
                self.cells = max(self.cells, at)

    def goes(self, index: MultiIndex, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Area and cell of each vector; and rows (vector, area, bits of the cells that it visits there) for its own area and the others that it goes to."""
        i, j = index.cells(x)
        own = self.area[i, j]
        who, one, two = index.visits(x)
        to = self.area[one, two]
        on = (to == own[who]) | hosted(own[who], to)
        who, to, place = np.concatenate([who[on], np.arange(len(x))]), np.concatenate([to[on], own]), np.concatenate([self.place[one, two][on], self.place[i, j]])
        keys, row = np.unique(who * (self.area.max() + 1) + to, return_inverse=True)
        seen = np.zeros((len(keys), self.cells), bool)
        seen[row, place] = True
        return own, self.place[i, j], keys // (self.area.max() + 1), keys % (self.area.max() + 1), np.packbits(seen, axis=1)


def hosted(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a pair of vectors in two different areas is compared in the other's: the same answer from either side, and evenly."""
    return ((one + other) % 2 == 1) == (one < other)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in parts(batches, 256):
        if batch.num_rows:
            yield batch, unit(_padded(batch.column(4), width))


def _cells(index: MultiIndex, width: int):
    """How many vectors each cell has, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _batches(batches, width):
            cells, n = np.unique(np.stack(index.cells(x)), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*cells, n)], ["i", "j", "n"])

    return run


SIZES = "label string, dim int, area long, own long, queries long"
LAID = "label string, dim int, area long, query boolean, class long, copies long, j int, mask binary, vector binary"


def _count(index: MultiIndex, grid: Grid, width: int):
    """How many vectors each area has and how many come to it from others, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, width):
            counts: dict[tuple, list[int]] = {}
            label, dim = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, _, who, area, _ = grid.goes(index, x)
            for k, to in zip(who.tolist(), area.tolist(), strict=True):
                counts.setdefault((label[k], dim[k], to), [0, 0])[int(own[k] != to)] += 1
            rows = list(zip(*((*key, *n) for key, n in counts.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in SIZES.split(", ")])

    return run


def _lay(index: MultiIndex, grid: Grid, width: int):
    """A row of the index for every vector, in its own area, and a query row for every other area to which it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch, x in _batches(batches, width):
            label, dim, of, copies = (batch.column(k).to_pylist() for k in range(4))
            raw = [np.asarray(v.values).tobytes() for v in batch.column(4)]
            own, cell, who, area, bits = grid.goes(index, x)
            rows = [(label[k], dim[k], to, bool(own[k] != to), of[k], copies[k], int(cell[k]), m.tobytes(), raw[k]) for k, to, m in zip(who.tolist(), area.tolist(), bits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LAID.split(", ")])

    return run


def _side(rows, kind: str, words: int) -> tuple:
    x = unit(np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), -1))
    mask = np.unpackbits(np.frombuffer(b"".join(rows["mask"]), np.uint8).reshape(len(rows), -1), axis=1, count=words).astype(bool)
    return x, rows["class"].to_numpy(), rows["copies"].to_numpy(), rows["j"].to_numpy(), mask


def _linked(q: tuple, x: tuple, threshold: float, both: bool) -> np.ndarray:
    """Which vectors of x each of q links, cell by cell; with `both`, also where only the traversal of x's vector comes to q's."""
    links = np.zeros((len(q[0]), len(x[0])), bool)
    for j in np.unique(x[3]):
        at = np.flatnonzero(x[3] == j)
        asks = np.flatnonzero(q[4][:, j])
        if len(asks):
            links[np.ix_(asks, at)] = q[0][asks] @ x[0][at].T >= threshold
    if both:
        links |= _linked(x, q, threshold, False).T
    return links


def _compare(kind: str, words: int, threshold: float):
    """Per block: for each vector with a link, the smallest class that links in the block reach, and how many vectors it links."""

    def found(links: np.ndarray, one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hit_q, hit_x = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        links = links[np.ix_(hit_q, hit_x)]
        one, other, n_one, n_other = one[hit_q], other[hit_x], n_one[hit_q], n_other[hit_x]
        low_q, low_x = one.copy(), other.copy()
        top = np.iinfo(np.int64).max
        while len(hit_q):
            new_q = np.minimum(low_q, np.where(links, low_x[None], top).min(1))
            new_x = np.minimum(low_x, np.where(links, new_q[:, None], top).min(0))
            if (new_q == low_q).all() and (new_x == low_x).all():
                break
            low_q, low_x = new_q, new_x
        return [(one, low_q, links @ n_other), (other, low_x, links.T @ n_one)]

    def run(key, rows):
        import pandas as pd

        self_block = int(key[4])
        own = rows[~rows["query"] & (rows["block"] == key[3])]
        x = _side(own, kind, words)
        out = []
        if self_block == 0 and len(own):  # the first block of queries comes with the index block's own vectors
            step = max(1, MATRIX // len(own))
            for lo in range(0, len(own), step):
                q = tuple(v[lo : lo + step] for v in x)
                links = np.triu(_linked(q, x, threshold, True), lo + 1)
                out += found(links, q[1], x[1], q[2], x[2])
        other = rows[rows["query"]] if self_block >= 0 else rows[rows["block"] == -1 - self_block]
        if len(other) and len(own):
            step = max(1, MATRIX // len(own))
            for lo in range(0, len(other), step):
                q = _side(other.iloc[lo : lo + step], kind, words)
                out += found(_linked(q, x, threshold, self_block < 0), q[1], x[1], q[2], x[2])
        if not out:
            return pd.DataFrame({"class": [], "near": [], "links": []}).astype("int64")
        return pd.DataFrame(dict(zip(("class", "near", "links"), map(np.concatenate, zip(*out, strict=True)), strict=True))).astype("int64")

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, target: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Compared are vectors of one label (not null) and length; vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows without a vec_id, whose component_id is null and which are
    kept. Equal vectors are one row with a count before they are compared, by a grouping that Spark combines before the
    shuffle, and only their number enters n_links; rows that repeat a vec_id with other vectors are vectors of their
    own, whose component_id is the smallest vec_id of their component. Cells
    are joined to areas; a pair of vectors in different areas is compared in one of the two, which both sides know, so a
    vector goes to about half of the areas that its traversal visits, as its raw components. Large areas and their
    queries are split into blocks of bounded size; of a block's links only a forest and counts leave it. Every
    vector is indexed and every vector is a query. An empty table gives an empty result; other columns are ignored.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    embedding = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    usable = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable, F.lit(False))
    rows = vectors.select("vec_id", embedding.alias("embedding"), F.col("label").cast("string").alias("label")).withColumn("ok", ok)
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label"))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("first"), F.count("*").alias("copies"))
    classes = classes.select("h1", "h2", "copies", F.col("first.vec_id").alias("rep"), "first.label", "first.embedding", F.size("first.embedding").alias("dim"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    width = max(2, (size["dim"] or 2) + (size["dim"] or 2) % 2)
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    fitted = unit(_padded(picked, width)) if len(picked) else np.zeros((0, width))
    index = MultiIndex(fitted, threshold, target, words=int(min(MOST_WORDS, max(4, round((size["n"] or 1) ** 0.25)))))

    read, place = classes.select("label", "dim", "class", "copies", "embedding"), ["label", "dim", "area"]
    counts = np.zeros([len(b) for b in index.books], np.int64)
    for r in read.mapInArrow(_cells(index, width), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # MOST_WORDS² rows at most
        counts[r["i"], r["j"]] = r["n"]
    grid = Grid(index, counts, INDEX_BLOCK)
    sizes = read.mapInArrow(_count(index, grid, width), SIZES).groupBy(*place).agg(F.sum("own").alias("own"), F.sum("queries").alias("queries")).where("own > 0")
    bound = lambda rows, most: F.least(F.lit(rows), F.ceil(F.lit(most) / (F.col("dim") * int(kind[-1]) + 64)))
    n_own, n_queries = F.ceil(F.col("own") / bound(INDEX_BLOCK, INDEX_BYTES)), F.ceil(F.col("queries") / bound(QUERY_BLOCK, QUERY_BYTES))
    blocks = materialize(sizes.select(*place, n_own.cast("int").alias("_own"), F.greatest(F.lit(1), n_queries).cast("int").alias("_queries")), "areas")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    dealt = read.mapInArrow(_lay(index, grid, width), LAID).join(blocks, place)
    block = F.when(F.col("query"), mine("_queries")).otherwise(mine("_own"))
    dealt = dealt.withColumn("block", block)
    pair = lambda x, q: F.struct(x.cast("int").alias("x"), q.cast("int").alias("q"))
    none = F.array().cast("array<struct<x:int,q:int>>")
    # a vector of the index meets all blocks of queries, the blocks before its own, and in the blocks after its own those
    for_index = F.concat(
        F.transform(every(F.col("_queries")), lambda q: pair(F.col("block"), q)),
        F.when(F.col("block") > 0, F.transform(every(F.col("block")), lambda y: pair(F.col("block"), -1 - y))).otherwise(none),
        F.when(F.col("block") + 1 < F.col("_own"), F.transform(F.sequence(F.col("block") + 1, F.col("_own") - 1), lambda x: pair(x, -1 - F.col("block")))).otherwise(none),
    )
    for_query = F.transform(every(F.col("_own")), lambda x: pair(x, F.col("block")))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("query"), for_query).otherwise(for_index)))
    dealt = dealt.select(*place, F.col("_to.x").alias("x"), F.col("_to.q").alias("q"), "query", "block", "class", "copies", "j", "mask", "vector")
    found = materialize(dealt.groupBy(*place, "x", "q").applyInPandas(_compare(kind, grid.cells, threshold), "class long, near long, links long"), "found")

    components = connected_components(found.select(F.col("class").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "class")
    smallest = components.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("component_id"))
    components = components.join(smallest, "component").select("class", "component_id")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    placed = classes.select("h1", "h2", "copies", "class", "rep").join(counts, "class", "left").join(components, "class", "left")
    placed = placed.where("copies > 1 or links is not null").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.where("ok").select("vec_id", "h1", "h2").join(placed, ["h1", "h2"], "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and len(embedding) > 0 and list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')
      and list_aggregate(list_transform(embedding, lambda x: x <> 0), 'bool_or')
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, b) as (
    select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), best as (select a, least(a, min(b)) as component_id from reach group by a),
n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(best.component_id, e.vec_id) as component_id, coalesce(best.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join best on best.a = e.vec_id
"""
