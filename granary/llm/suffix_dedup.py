"""Passages that occur twice anywhere, by a distributed merge sort of suffixes that never compares known prefixes again.

A text's suffixes are sampled at anchors: of the K-byte strings in a window of `length` bytes, the one with the smallest
hash, the first of equal ones, is the window's anchor. Equal windows have their anchors at the same place, so it is
enough to sort the suffixes that begin at anchors, each once for all windows that share it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import bucketed, carried, finished, give_back, quoted, ship, table, unused

LENGTH = 200
#: Window starts that are hashed at once, and hashes that a task holds before it sends them.
SEGMENT, HELD = 1 << 20, 1 << 19
#: A block of texts is a share of all bytes within these bounds; what is sorted in one place is as many parts as there are blocks.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4 << 20, 32 << 20, 256
#: Splitters of the sort come from a sample of about so many strings of about so many bytes of text; there are at most
#: MOST_RANGES ranges, which more parts share by a checksum.
SAMPLE_STRINGS, SAMPLE_BYTES, MOST_RANGES = 20_000, 16 << 20, 4096
#: Entries that are compared to the left at once.
COMPARED = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1

TEXT = "hash binary, n long, text string, block int"
RUN = "target int, block int, lcps binary, sizes binary, tails binary, left_sizes binary, lefts binary, counts binary, places binary"


class Geometry:
    """How windows of `length` bytes are cut: anchors of k bytes, in two halves by their distance from the window's start.

    An entry is an anchor with the windows of one half that have it; it is sorted by the string from its core on, and
    the core, `core` bytes, lies in all of its windows.
    """

    def __init__(self, length: int):
        if not 2 <= length < 1 << 15:
            raise ValueError("2 to 32,767 bytes")
        self.length, self.k = length, max(1, length * 8 // 25)
        self.span = length - self.k + 1
        self.half = -(-self.span // 2)
        self.core = length - self.half + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def entries(data: np.ndarray, offsets: np.ndarray, g: Geometry) -> Iterator[tuple[np.ndarray, ...]]:
    """(core, least, most, hash) of the entries of texts that lie end to end in data, text i from offsets[i] to offsets[i + 1].

    A window of the entry begins a bytes before the core, for every a from least to most. hash: of the core.
    """
    n = min(SEGMENT, len(data)) + g.length
    up = np.multiply.accumulate(np.full(n, BASE, np.uint64))
    down = np.multiply.accumulate(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    low = np.uint64((1 << 21) - 1)
    for lo in range(0, len(data) - g.length + 1, SEGMENT):
        x = data[lo : lo + SEGMENT + g.length - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
        ks = len(x) - g.k + 1
        v = (_mixed((sums[g.k :] - sums[:-g.k]) * down[:ks]) & ~low) | np.arange(ks, dtype=np.uint64)
        rows = np.full(-(-ks // g.span) * g.span, np.iinfo(np.uint64).max, np.uint64)
        rows[:ks] = v
        rows = rows.reshape(-1, g.span)
        ahead, behind = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        starts = ks - g.span + 1
        first = np.minimum(behind[:starts], ahead[g.span - 1 : g.span - 1 + starts])
        a, b = np.searchsorted(offsets, [lo, lo + starts - 1], "right")
        cuts = np.clip(offsets[a - 1 : b + 1] - lo, 0, starts)
        ends = np.repeat(offsets[a : b + 1] - lo, np.diff(cuts))
        s = np.flatnonzero(np.arange(starts) + g.length <= ends)
        if not len(s):
            continue
        anchor = (first[s] & low).astype(np.int64)
        second = anchor - s >= g.half
        key = 2 * anchor + second
        new = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(s) != 1))))
        last = np.append(new[1:], len(s)) - 1
        core = anchor[new] - g.half * second[new]
        yield core + lo, core - s[last], core - s[new], _mixed((sums[core + g.core] - sums[core]) * down[core])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, end to end, and where each begins (and the last ends)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, content = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cores(length: int):
    """(hash, block, often) of the cores in each block, each once for as many as a task holds; often: it occurs twice among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, n = Geometry(length), [], 0

        def sent():
            h, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h, b))
            h, b = h[order], b[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1]))))
            often = np.diff(np.append(new, len(h))) > 1
            return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(b[new]), pa.array(often)], ["hash", "block", "often"])

        for batch in batches:
            data, offsets = strings(batch.column(0))
            blocks = batch.column(1).to_numpy()
            for core, _, _, h in entries(data, offsets, g):
                held.append((h, blocks[np.searchsorted(offsets, core, "right") - 1]))
                n += len(h)
                if n >= HELD:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()
        give_back()

    return run


def _sampled(length: int, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Geometry(length)
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for core, _, _, h in entries(data, offsets, g):
                found = [data[c : c + g.core].tobytes() for c in core[h % np.uint64(rate) == 0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["core"])

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(run: list[bytes]) -> Iterator[int]:
    """The length of the prefix that each string of a sorted run shares with the one before it."""
    before = b""
    for s in run:
        yield common_prefix(before, s, 0)
        before = s


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the string before) of the strings of all runs in sorted order.

    A loser tree in which each loser keeps the length of the prefix that it shares with the winner that passed it last.
    Of two strings with prefixes of unequal length the one with the longer wins unseen; else they are compared beyond it.
    """
    n = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (n - len(runs))
    known, at, losers = [0] * n, [0] * n, [0] * n

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of the heads of runs i and j."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        h = known[i]
        if h != known[j]:
            return (i, j) if h > known[j] else (j, i)
        h = common_prefix(a, b, h)
        i, j = (i, j) if len(a) == h or len(b) > h and a[h] < b[h] else (j, i)
        known[j] = h
        return i, j

    level = list(range(n))
    base = n
    while len(level) > 1:
        base //= 2
        games = [play(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        losers[base : base + len(games)] = [x[1] for x in games]
        level = [x[0] for x in games]
    top = level[0]
    while heads[top] is not None:
        yield top, at[top], known[top]
        at[top] += 1
        own, lcps = runs[top]
        if at[top] < len(own):
            heads[top], known[top] = own[at[top]], lcps[at[top]]
        else:
            heads[top] = None
        k = (top + n) // 2
        while k:
            top, losers[k] = play(top, losers[k])
            k //= 2


def _pack(values, kind: str) -> bytes:
    return np.array(values, kind).tobytes()


def _runs(length: int, splitters: list[bytes], shared: int):
    """Sorted, front-coded runs of the entries of a block whose core occurs twice, cut at the splitters."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        g, out = Geometry(length), []
        if texts.num_rows and wanted.num_rows:
            block = texts.column("block")[0].as_py()
            data, offsets = strings(texts.sort_by("hash").column("text"))
            hashes = np.unique(wanted.column("core_hash").to_numpy().view(np.uint64))
            places: dict[tuple[bytes, bytes], list[int]] = {}
            for core, least, most, h in entries(data, offsets, g):
                kept = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
                core, least, most = core[kept], least[kept], most[kept]
                which = np.searchsorted(offsets, core, "right") - 1
                for c, lo, hi, i, at in zip(core.tolist(), least.tolist(), most.tolist(), which.tolist(), (core - offsets[which]).tolist(), strict=True):
                    places.setdefault((data[c : c + g.length - lo].tobytes(), data[c - hi : c].tobytes()), []).extend((i, at))
            cut: dict[int, list] = {}
            for key in sorted(places):
                core = key[0][: g.core]
                cut.setdefault(bisect_right(splitters, core) * shared + zlib.crc32(core) % shared, []).append(key)
            for target, keys in cut.items():
                lcps, own = list(front_coded([s for s, _ in keys])), [places[key] for key in keys]
                tails = b"".join(s[h:] for (s, _), h in zip(keys, lcps, strict=True))
                out.append((
                    target, block, _pack(lcps, "<u2"), _pack([len(s) for s, _ in keys], "<u2"), tails, _pack([len(x) for _, x in keys], "<u2"), b"".join(x for _, x in keys),
                    _pack([len(p) // 2 for p in own], "<u4"), _pack([x for p in own for x in p], "<u4"),
                ))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        names = [x.split()[0] for x in RUN.split(", ")]
        give_back()
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return run


def repeats(rights: list[bytes], lcps: np.ndarray, lefts: list[bytes], counts: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, from, to): the windows of each entry, by bytes before the core, that occur twice.

    rights: sorted strings from the core on, with their common prefixes; lefts: what is before the core. A window a bytes
    before the core is known by its right part, which is one of the intervals that the common prefixes cut at its
    length, and by its left part, in the same way in the order of the reversed lefts; windows are equal if both are.
    """
    n = len(rights)
    least, most = g.length - np.fromiter(map(len, rights), np.int64, n), np.fromiter(map(len, lefts), np.int64, n)
    group = np.cumsum(lcps < g.core)
    width = max(1, g.half - 1)
    padded = np.frombuffer(b"".join(int(k).to_bytes(8) + x[::-1].ljust(width, b"\0") for k, x in zip(group.tolist(), lefts, strict=True)), np.uint8).reshape(n, 8 + width)
    order = np.argsort(padded.view(f"S{8 + width}").ravel(), kind="stable")
    laid = padded[order]
    unlike = laid[1:] != laid[:-1]
    same = np.where(unlike.any(1), unlike.argmax(1), 8 + width) - 8  # negative where a group ends
    twice = np.zeros((n, g.half + 1), np.int8)
    left = np.empty(n, np.int64)
    for a in range(g.half):
        own = np.flatnonzero((least <= a) & (a <= most))
        if not len(own):
            continue
        left[order] = np.concatenate(([0], np.cumsum((same < a) | (same < 0))))
        key = (np.cumsum(lcps < g.length - a) * (n + 1) + left)[own]
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        twice[own, a] = (often[which] > 1) | (counts[own] > 1)
    edges = np.diff(twice, axis=1, prepend=0)
    entry, first = np.nonzero(edges == 1)
    return entry, first, np.nonzero(edges == -1)[1] - 1


def _merge(length: int):
    """Merges the runs of a part and returns, by block, which bytes of which texts lie in a string that occurs twice."""

    def run(rows: pa.Table) -> pa.Table:
        g = Geometry(length)
        runs, extras, blocks = [], [], rows.column("block").to_pylist()
        for r in range(rows.num_rows):
            get = lambda name, kind, r=r: np.frombuffer(rows.column(name)[r].as_buffer(), kind)
            lcps, sizes, left_sizes, counts = get("lcps", "<u2").tolist(), get("sizes", "<u2").tolist(), get("left_sizes", "<u2").tolist(), get("counts", "<u4")
            tails, lefts, own, beside, before, t, u = rows.column("tails")[r].as_py(), rows.column("lefts")[r].as_py(), [], [], b"", 0, 0
            for h, size, left in zip(lcps, sizes, left_sizes, strict=True):
                before = before[:h] + tails[t : t + size - h]
                own.append(before)
                beside.append(lefts[u : u + left])
                t, u = t + size - h, u + left
            runs.append((own, lcps))
            extras.append((beside, counts, np.append(0, np.cumsum(counts, dtype=np.int64)), get("places", "<u4").reshape(-1, 2)))
        found: dict[int, list[np.ndarray]] = {}
        held: list[tuple[int, int, int]] = []

        def settle() -> None:
            if not held:
                return
            rights, lefts = [runs[r][0][k] for r, k, _ in held], [extras[r][0][k] for r, k, _ in held]
            counts = np.array([extras[r][1][k] for r, k, _ in held], np.int64)
            for e, lo, hi in zip(*(x.tolist() for x in repeats(rights, np.array([h for *_, h in held]), lefts, counts, g)), strict=True):
                r, k, _ = held[e]
                _, _, at, places = extras[r]
                own = places[at[k] : at[k + 1]].astype(np.int64)
                found.setdefault(blocks[r], []).append(np.column_stack((own[:, 0], own[:, 1] - hi, own[:, 1] - lo + g.length)))
            held.clear()

        group: list[tuple[int, int, int]] = []
        for r, k, h in merged(runs):
            if h < g.core:
                if len(group) > 1 or group and extras[group[0][0]][1][group[0][1]] > 1:
                    held += group
                if len(held) >= COMPARED:
                    settle()
                group = []
            group.append((r, k, h if group else 0))
        if len(group) > 1 or group and extras[group[0][0]][1][group[0][1]] > 1:
            held += group
        settle()
        give_back()
        return pa.table([pa.array(list(found), pa.int32()), pa.array([np.concatenate(x).astype("<u4").tobytes() for x in found.values()], pa.binary())], ["block", "marks"])

    return run


def _cut(length: int):
    """Spans and rest of each text of a block, from the marks that all parts have for it."""

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        texts = texts.sort_by("hash")
        data, offsets = strings(texts.column("text"))
        depth = np.zeros(len(data) + 1, np.int32)
        for m in marks.column("marks").to_pylist():
            rows = np.frombuffer(m, "<u4").reshape(-1, 3).astype(np.int64)
            at = offsets[rows[:, 0]]
            np.add.at(depth, at + rows[:, 1], 1)
            np.add.at(depth, at + rows[:, 2], -1)
        gone = np.cumsum(depth[:-1]) > 0
        spans, kept = [], []
        for lo, hi, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts.column("n").to_pylist(), strict=True):
            if n > 1 and hi - lo >= length:
                gone[lo:hi] = True
            own = gone[lo:hi]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(data[lo:hi][~own].tobytes() if edges else data[lo:hi].tobytes())
        give_back()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([texts.column("hash"), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["hash", "n_bytes", "spans", "kept"])

    return run


def text_key(text: Column) -> Column:
    """What tells texts apart: the SHA-256 of their UTF-8 bytes (null: empty)."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(hash, n_bytes, spans, kept) of every different text of docs: what is left without bytes in repeated strings.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another row;
    strings are judged on the input. spans: the removed runs, by bytes. kept may end inside a character, so it is binary.
    hash: text_key(). Null texts are empty; texts shorter than `length` stay; rows with equal text are copies of each
    other whatever their other columns; an empty table gives an empty result.

    1. Texts become different texts (copies combined in each task), in a bucketed table of blocks in the shared folder.
    2. Every block sends the hashes of its cores, each once; those that no other place has prove that their windows
       occur once. The others go back to their blocks, each once, so a hot passage is a row for each block.
    3. A block sorts the strings of its remaining entries, equal ones become one, and sends them in front-coded runs to
       the parts that splitters cut. Parts merge runs by a loser tree, and common prefixes tell which windows are equal.
    4. Marks go back to the blocks, once more without the texts, which no shuffle moves after the first step.
    """
    spark, g = docs.sparkSession, Geometry(length)
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))))
    different = docs.select(text_key(F.col("text")).alias("hash"), text.alias("text")).groupBy("hash").agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    texts = bucketed(different.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")), "texts", min(50_000, -(-blocks // 4)), "block")

    skip = max(1, total // SAMPLE_BYTES)
    rate = max(1, min(total, SAMPLE_BYTES) // (g.half * SAMPLE_STRINGS))
    sample = texts.where(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(skip)) == 0).select("text").mapInArrow(_sampled(length, rate), "core binary")
    ranges = min(blocks, MOST_RANGES)
    seen = sorted(bytes(r[0]) for r in sample.limit(4 * SAMPLE_STRINGS).collect())  # a bounded number; it decides only how even the parts are
    splitters = sorted({seen[k * len(seen) // ranges] for k in range(1, ranges)}) if seen else []

    cores = texts.select("text", "block").mapInArrow(_cores(length), "hash long, block int, often boolean")
    places = F.count("*").over(Window.partitionBy("hash"))  # at most a few rows for each block
    wanted = cores.withColumn("places", places).where("places > 1 or often").select(F.col("hash").alias("core_hash"), "block")
    runs = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_runs(length, splitters, -(-blocks // ranges)), RUN)
    marks = runs.groupBy("target").applyInArrow(_merge(length), "block int, marks binary")
    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut(length), "hash binary, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, spans and kept of cut_repeats(); columns of docs with these names give way.

    Rows with equal text, however many, read one row of the result; Spark splits that key of the join if it is hot.
    """
    docs = docs.select(*map(quoted, carried(docs.columns, ("n_bytes", "spans", "kept"))))
    key = unused("_hash", docs.columns)
    found = finished(lambda: cut_repeats(docs, length), "repeats").withColumnRenamed("hash", key)
    return docs.withColumn(key, text_key(F.col("text"))).join(found, key, "left").drop(key)


def op13_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = cut_repeats(docs).select("hash", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    found = finished(lambda: found, "repeats")
    return docs.select("doc_id", text_key(F.col("text")).alias("hash")).join(found, "hash", "left").drop("hash")
