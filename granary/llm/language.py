"""Language identification by rank-order profiles of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import carried, map_carrying, materialize, parts, table

#: Entries of a profile; also what an n-gram costs that a profile doesn't have.
PROFILE = 400
#: At most about so many documents, spread by a hash over all that have a language, are read to learn profiles.
MAX_TRAINING_DOCS = 60_000
#: A value of lang with fewer n-grams than this in all that is read has no profile; so there are never more profiles than text bears.
LEAST_NGRAMS = 400
UNKNOWN = "und"


def _letters_table() -> np.ndarray:
    """For every code point: itself if it is a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, points, np.uint32(32))


_LETTERS: np.ndarray | None = None


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters inside lower-cased words, a space standing for a word's edge."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters_table()
    c = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    c = c[keep].astype(np.int64)
    edge = c == 32
    one = c[~edge]
    two = (c[:-1] << 21 | c[1:])[~(edge[:-1] & edge[1:])]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~(edge[1:-1] | edge[:-2] & edge[2:])]
    return np.concatenate([one, two, three])


def top_codes(text: str, size: int = PROFILE) -> np.ndarray:
    """The document's profile: its most frequent n-grams, ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language, combined per batch."""
    for batch in batches:  # of bounded bytes
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts(iter([batch]), 200):
            own: dict[str, list[str]] = {}
            for text, lang in zip(part.column(0), part.column(1), strict=True):
                own.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, texts in own.items():
                codes, counts = np.unique(ngrams("\n".join(texts)), return_counts=True)
                if lang in sums:
                    codes, at = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([sums[lang][1], counts])).astype(np.int64)
                sums[lang] = codes, counts
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])


def learn_profiles(docs: DataFrame, allowed: Column, size: int = PROFILE, max_docs: int = MAX_TRAINING_DOCS) -> dict[str, np.ndarray]:
    """For each lang value of the allowed rows with text, its `size` most frequent n-grams, most frequent first.

    Reads at most about max_docs rows, chosen by a hash of doc_id; what reaches the driver is `size` rows for each
    language that has LEAST_NGRAMS in them, as Arrow columns.
    """
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.where(allowed & F.col("lang").isNotNull()).count()
    part = min(1.0, max_docs / max(1, n))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))
    counts = known.where(spread | F.lit(part == 1.0)).select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_count, "lang string, code long, n long")
    counts = materialize(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    enough = counts.groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_NGRAMS).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).join(enough, "lang", "left_semi").select("lang", "rank", "code").toArrow()
    top = top.sort_by([("lang", "ascending"), ("rank", "ascending")])
    langs, codes = top["lang"].to_pylist(), top["code"].to_numpy()
    starts = [k for k in range(len(langs)) if not k or langs[k] != langs[k - 1]]
    return {langs[lo]: codes[lo:hi] for lo, hi in zip(starts, [*starts[1:], len(langs)], strict=True)} if langs else {}


class RankOrder:
    """Out-of-place distances from all profiles at once; what a document's n-grams have in common with profiles is looked up, however many there are."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        own = [profiles[x] for x in self.langs] or [np.zeros(0, np.int64)]
        codes = np.concatenate(own)
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.lang = np.repeat(np.arange(len(own)), [len(x) for x in own])[order]
        self.rank = np.concatenate([np.arange(len(x)) for x in own])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 less its distance as a share of the largest possible."""
        own = top_codes(text, self.size) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        lo, hi = np.searchsorted(self.codes, own), np.searchsorted(self.codes, own, "right")
        n = hi - lo
        place = np.repeat(np.arange(len(own)), n)  # of each match, where the document has it
        at = np.arange(len(place)) + np.repeat(lo - (np.cumsum(n) - n), n)
        near = np.bincount(self.lang[at], self.size - np.abs(self.rank[at] - place), len(self.langs))
        best = int(np.argmax(near))
        return self.langs[best], float(near[best] / (self.size * len(own)))


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], carry: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """The carried columns (all by default), lang_pred and score of every whole text; `und`, 0 for null texts and texts without a letter.

    A prediction sees the text alone. Where no language was learned (no lang values, empty table), all are `und`.
    Each row is read alone: ties and repeated rows change nothing. Columns of docs with these two names give way.
    """
    carry = carried(docs.columns if carry is None else carry, ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(profiles, size)
        for batch in parts(batches, 1000):
            found = [model.predict(text.as_py()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return map_carrying(docs, F.col("text").cast("string"), carry, run, "lang_pred string, score double")


def held_out() -> Column:
    """Rows that are not learned from: the remainder of the id's checksum is 1."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def op7_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs, ~held_out())
    return predict_languages(docs.select("doc_id", "text", held_out().alias("held_out")), profiles, ["doc_id", "held_out"])
