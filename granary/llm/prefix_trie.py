"""The trie of conversation prefixes, from common prefixes of sorted neighbours, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import WORD, give_back, materialize, quoted, table
from granary.llm.suffix_dedup import common_prefix

#: Bytes of a turn's key: the first half of a SHA-256.
KEY = 16
#: A partition of the sorted conversations holds about so many turns; a step joins the forests of so many neighbours.
PART_TURNS, FAN = 50_000, 64
#: Conversation ids in one row of those that end at a node of a partition's border.
CHUNK_IDS = 50_000
NONE = np.iinfo(np.int64).max
#: Own figures of a node by depth along a path: members, smallest member, children, leaves and savings that are settled.
N, LEAST, CHILDREN, LEAVES, SAVED = range(5)

ROWS = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary,"
    " part long, side int, path binary, words binary, own binary, ids string"
)
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in ROWS.split(", ")])


def hashed_ids(ids: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def node_keys(path: bytes) -> list[bytes]:
    """A key of each prefix of a path, from the empty one on."""
    h = hashlib.sha256()
    out = [h.digest()[:KEY]]
    for at in range(0, len(path), KEY):
        h.update(path[at : at + KEY])
        out.append(h.copy().digest()[:KEY])
    return out


class Forest:
    """Nodes of the trie of sorted paths, built upwards.

    Neighbours' common prefixes are edges, joined by union-find from the longest to the shortest. A component stands at
    one node; before it is joined it climbs to the edge's depth, and every node that it leaves is complete, since no
    shorter edge can add to it. A merge makes or widens a branching node. Components with the first or the last path
    may go on in another partition: unless `whole`, the nodes they leave become figures along those two paths.
    """

    def __init__(self, paths: list[bytes], words: list[np.ndarray], own: list[np.ndarray | None], top: list[list[int]], ends: list[list[int]], whole: bool, keyed: bool):
        """top: the figures of each path's last node, beside own (by depth, above it). keyed: rows carry keys, not hashes of ends."""
        self.paths, self.words, self.whole, self.keyed = paths, words, whole, keyed
        m = len(paths)
        self.over = list(range(m))
        self.depth = [len(p) // KEY for p in paths]
        self.node, self.own, self.ends = top, own, ends
        self.rows: list[list] = []
        self.kids: list[list[int]] = [[] for _ in range(m)]
        self.outer = [0 in (i, m - 1 - i) for i in range(m)]
        self.first = [i == 0 for i in range(m)]
        self.spines = [{}, {}]
        self.chunks: list[tuple[bytes, list[int]]] = []
        self.keys: dict[int, list[bytes]] = {}

    def find(self, i: int) -> int:
        while self.over[i] != i:
            self.over[i] = self.over[self.over[i]]
            i = self.over[i]
        return i

    def key(self, r: int, depth: int) -> bytes:
        if r not in self.keys:
            self.keys = {r: node_keys(self.paths[r])} if len(self.keys) > 8 else self.keys | {r: node_keys(self.paths[r])}
        return self.keys[r][depth]

    def leave(self, r: int) -> list[int]:
        """Settles the node that component r stands at; what it adds to its parent."""
        d, node = self.depth[r], self.node[r]
        if self.outer[r] and not self.whole:
            key = self.key(r, d)
            self.spines[not self.first[r]][d] = node
            for k in self.kids[r]:
                self.rows[k][10] = key
            if self.ends[r]:
                self.chunks.append((key, self.ends[r]))
            self.kids[r], self.ends[r] = [], []
            return [0, NONE, 0, 0, 0]
        n, least, children, leaves, saved = node
        leaves = leaves if children else 1
        saved += (n - 1) * int(self.words[r][d - 1]) if d else 0
        for k in self.kids[r]:
            self.rows[k][3] = least
        self.kids[r] = [len(self.rows)]
        self.rows.append(["node", least, d, None, n, children, leaves, saved, None if self.keyed else hashed_ids(self.ends[r]), self.key(r, d) if self.keyed else None, None, *[None] * 6])
        self.ends[r] = []
        return [n, least, 1, leaves, saved]

    def climb(self, r: int, depth: int) -> None:
        own = self.own[r]
        while self.depth[r] > depth:
            up = self.leave(r)
            self.depth[r] -= 1
            self.node[r] = up if own is None else _sum(up, own[self.depth[r]].tolist())

    def build(self) -> None:
        lcps = [common_prefix(a, b, 0) // KEY for a, b in zip(self.paths, self.paths[1:])]
        for i in sorted(range(len(lcps)), key=lambda i: -lcps[i]):
            r, s = self.find(i), self.find(i + 1)
            self.climb(r, lcps[i])
            self.climb(s, lcps[i])
            self.over[s] = r
            self.node[r] = _sum(self.node[r], self.node[s])
            self.kids[r] += self.kids[s]
            self.ends[r] += self.ends[s]
            self.outer[r] |= self.outer[s]
            self.first[r] |= self.first[s]
            if self.own[s] is not None:
                a, b = self.own[r][: lcps[i]], self.own[s][: lcps[i]]
                self.own[r] = np.where(np.arange(5) == LEAST, np.minimum(a, b), a + b)
        r = self.find(0)
        self.climb(r, 0)
        self.leave(r)

    def spine_rows(self, part: int) -> Iterator[list]:
        """The first and the last path with the figures of their nodes, each node once."""
        for side, found in enumerate(self.spines):
            path, words = (self.paths[-side], self.words[-side]) if found else (b"", None)
            own = np.full((len(path) // KEY + 1, 5), 0, np.int64)
            own[:, LEAST] = NONE
            for d, node in found.items():
                own[d] = node
            if found:
                yield ["spine", *[None] * 10, part, side, path, words.astype("<i4").tobytes(), own.tobytes(), None]

    def chunk_rows(self) -> Iterator[list]:
        for key, ids in self.chunks:
            for lo in range(0, len(ids), CHUNK_IDS):
                own = ids[lo : lo + CHUNK_IDS]
                yield ["ends", own[0], *[None] * 7, key, *[None] * 6, ",".join(map(str, own))]


def _sum(a: list[int], b: list[int]) -> list[int]:
    return [a[N] + b[N], min(a[LEAST], b[LEAST]), a[CHILDREN] + b[CHILDREN], a[LEAVES] + b[LEAVES], a[SAVED] + b[SAVED]]


def _batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 20_000):
        own = rows[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], t.type) for k, t in enumerate(SCHEMA)], schema=SCHEMA)


def _sorted_part(whole: bool):
    """The forest of a partition of sorted conversations; those with equal turns are one path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, words, top, ends, part = [], [], [], [], None
        for batch in batches:
            for c, path, own, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = p
                if not paths or path != paths[-1]:
                    paths.append(path)
                    words.append(np.array(own, np.int32))
                    top.append([0, c, 0, 0, 0])
                    ends.append([])
                top[-1][N] += 1
                ends[-1].append(c)
        if paths:
            forest = Forest(paths, words, [None] * len(paths), top, ends, whole, False)
            forest.build()
            yield from _batches([*forest.rows, *forest.spine_rows(part), *forest.chunk_rows()])
        give_back()

    return run


def _joined(whole: bool):
    """The forest of the border paths of neighbouring partitions, contracted to its own two border paths."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("side", "ascending")])
        paths = rows.column("path").to_pylist()
        words = [np.frombuffer(x, "<i4") for x in rows.column("words").to_pylist()]
        own = [np.frombuffer(x, np.int64).reshape(-1, 5) for x in rows.column("own").to_pylist()]
        forest = Forest(paths, words, own, [x[-1].tolist() for x in own], [[] for _ in paths], whole, True)
        forest.build()
        return pa.Table.from_batches(_batches([*forest.rows, *forest.spine_rows(key[0].as_py())]), SCHEMA)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of nodes whose ids come in several rows, in order."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
                h.update(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])


def prefix_trie(paths: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each different prefix of the sequences of turns, from the empty one on, as op12's contract lists them.

    paths: (conv_id long, turns array<binary> of KEY bytes each, words array<int>), a row for each conversation; a
    sequence may be empty. An empty table gives no node, not even a root.

    Conversations are sorted by their turns and then their id into ranges, so that many equal ones are no hot range. Each
    range makes the forest of its own sequences; nodes on its first or last sequence may go on in the next range and
    are contracted to figures along those two. Steps join the forests of FAN neighbouring ranges until one is left: 64
    ranges need one, 4,096 two. A range holds its sequences, KEY bytes and a count for each turn; one conversation is
    one row.
    """
    spark = paths.sparkSession
    laid = materialize(paths.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x)), "")).alias("path"), "words"), "paths")
    turns = laid.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(1, -(-turns // part_turns))
    dealt = laid.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id") if parts > 1 else laid.coalesce(1).sortWithinPartitions("path", "conv_id")
    whole = parts == 1
    found = [materialize(dealt.select("conv_id", "path", "words", F.spark_partition_id().cast("long")).mapInArrow(_sorted_part(whole), ROWS), "forest")]
    ends = found[0].where("kind = 'ends'").select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_ends, "key binary, ends string")
    while not whole:
        parts = -(-parts // FAN)
        whole = parts == 1
        spines = found[-1].where("kind = 'spine'").withColumn("group", F.floor(F.col("part") / FAN).cast("long"))
        found.append(materialize(spines.groupBy("group").applyInArrow(_joined(whole), ROWS), "forest"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = [f.where("kind = 'node'").select(*columns, "node", "parent") for f in found]
    inner = nodes[0].where("parent is null").select(columns)  # most nodes: all that no border touches
    border = nodes[0].where("parent is not null")
    for more in nodes[1:]:
        border = border.union(more)
    at = border.where("node is not null").select(F.col("node").alias("at"), F.col("conv_id").alias("above"))
    border = border.join(at, F.col("parent") == F.col("at"), "left").join(ends, F.col("node") == F.col("key"), "left")
    filled = {"parent_conv_id": F.coalesce("parent_conv_id", "above"), "ends_sha256": F.coalesce("ends_sha256", "ends", F.lit(hashed_ids([])))}
    return inner.union(border.withColumns(filled).select(columns)) if len(found) > 1 else inner


def turn_key(role: Column, text: Column) -> Column:
    """KEY bytes that tell turns apart: of the SHA-256 of the role, its length before it, and the text."""
    return F.substring(F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)), 1, KEY)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, words) of each conversation in the order of its turns, null first; of equal turn numbers by role and then turn key.

    Null roles and texts are empty; rows without conv_id belong to no conversation and are left out; repeated rows are
    repeated turns; texts are read whole but only their keys and word counts go on. Other columns are not read.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    grouped = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select("conv_id", F.col("_turns.key").alias("turns"), F.col("_turns.words").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conversation_turns() with the first h turns of conversation c - c % 20 (below a negative c: the next multiple of 20) in place of c's own first h; h = crc32 of the decimal c, modulo 4.

    Only the first three turns of every twentieth conversation are joined, to at most twenty others.
    """
    heads = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_turns"), F.slice("words", 1, 3).alias("_words"))
    h = F.crc32(F.col("conv_id").cast("string")) % 4

    def spliced(own: str, head: str, kind: str) -> Column:
        first = F.slice(F.coalesce(F.col(head), F.array().cast(kind)), F.lit(1), h.cast("int"))
        return F.concat(first, F.slice(own, (h + 1).cast("int"), F.greatest(F.size(own) - h.cast("int"), F.lit(0)))).alias(own)

    joined = turns.join(heads, F.col("conv_id") - F.pmod("conv_id", F.lit(20)) == F.col("_base"), "left")
    return joined.select("conv_id", spliced("turns", "_turns", "array<binary>"), spliced("words", "_words", "array<int>"))


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(materialize(conversation_turns(table(spark, sf_dir, "conversations")), "turns")))


OP12_SQL = rf"""
with own as (
    select conv_id as c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda y: ascii(y)::bigint)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295) % 4 as h
    from conversations where conv_id is not null group by conv_id
), full_turns as (
    select o.c, list_concat(case when o.h = 0 then [] else coalesce(b.k[1:o.h], []) end, o.k[o.h + 1:]) as k from own o left join own b on b.c = o.c - (o.c % 20 + 20) % 20
), keyed as (
    select c, len(k) as n, list_transform(k, lambda s: md5(strlen(s.r) || ':' || s.r || s.x)) as keys, list_transform(k, lambda s: len(regexp_extract_all(s.x, '{WORD}'))) as words from full_turns
), member as (
    select c, n, d, array_to_string(keys[1:d], '') as p, case when d = 0 then 0 else words[d] end as w from (select *, unnest(range(0, n + 1)) as d from keyed)
), node as (
    select p, d, min(c) as conv_id, count(*) as n, any_value(w) as w, coalesce(string_agg(c::varchar, ',' order by c) filter (where d = n), '') as ends from member group by p, d
), up as (
    select *, case when d > 0 then left(p, 32 * (d - 1)::int) end as parent from node
), kids as (
    select parent, count(*) as n from up where d > 0 group by parent
), one as (
    select u.*, coalesce(k.n, 0) as n_children from up u left join kids k on k.parent = u.p
), below as (
    select a.p, sum((b.n_children = 0)::int) as n_leaves, sum((b.n - 1) * b.w) as saved from one a join one b on starts_with(b.p, a.p) group by a.p
)
select o.conv_id, o.d::bigint as depth, q.conv_id as parent_conv_id, o.n::bigint as n_convs, o.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, sha256(o.ends) as ends_sha256
from one o join below b using (p) left join node q on q.p = o.parent
"""
