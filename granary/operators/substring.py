"""Joins of short strings with the texts that contain them, without comparing each with each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Needles go to every task, as one automaton, up to so many and so many bytes of them together; beyond that grams meet by shuffle.
MOST_NEEDLES, MOST_BYTES = 200_000, 8 << 20
#: Characters of the grams by which needles and texts meet.
GRAM = 5


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, most: int = MOST_NEEDLES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of both sides for each row of texts that contains a needle, once however often it does.

    Null texts and null or empty needles join nothing; repeated needles join each. Names must differ between the sides.
    Few needles (counted, by number and bytes) go to all tasks as an automaton that finds all of them in one pass over a
    text; any number of others meet the texts by grams, see contains_by_grams().
    """
    present = needles.where(F.length(needle) > 0)
    size = present.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(needle)), F.lit(0)).alias("bytes")).first()
    if size["n"] > most or size["bytes"] > most_bytes:
        return contains_by_grams(texts, text, present, needle)
    words = sorted({r[0] for r in present.select(needle).collect()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, t in enumerate(batch.column(batch.schema.get_field_index(text))):
                if t.is_valid and words:
                    own = {w for _, w in automaton.iter(t.as_py())}
                    rows += [k] * len(own)
                    found += sorted(own)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], [*batch.schema.names, "_needle"])

    hits = texts.mapInArrow(search, StructType([*texts.schema.fields, StructField("_needle", needles.schema[needle].dataType)]))
    return hits.join(F.broadcast(present), F.col("_needle") == present[needle]).drop("_needle")


def contains_by_grams(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = GRAM) -> DataFrame:
    """contains_join() for any number of needles: each meets the texts at one of its grams, and is verified there.

    A text that contains a needle contains all of its grams; the needle is filed under the one that the fewest texts
    have, so that common grams carry no needles unless all of a needle's are common. Needles shorter than a gram are
    filed whole, under grams of their own length. Texts send their different grams of the lengths that occur, and only
    those under which a needle is filed meet anything; what is joined are ids of rows, and texts follow for candidates.
    """
    from granary.sources.shared import written

    at, key = "_row", "_needle_row"
    texts = written(texts.withColumn(at, F.monotonically_increasing_id()), "texts")
    needles = written(needles.withColumn(key, F.monotonically_increasing_id()), "needles")

    def grams(c: F.Column, n: int):
        return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))

    sizes = sorted(r[0] for r in needles.select(F.least(F.length(needle), F.lit(gram)).alias("n")).distinct().collect())  # at most `gram` numbers
    if not sizes:
        return texts.crossJoin(needles).where("false").drop(at, key)
    held = written(texts.where(F.length(text) > 0).select(at, F.explode(F.concat(*(grams(F.col(text), n) for n in sizes))).alias("gram")), "grams")
    offered = needles.select(key, F.explode(F.array_distinct(F.concat(*(F.when(F.least(F.length(needle), F.lit(gram)) == n, grams(F.col(needle), n)).otherwise(F.array().cast("array<string>")) for n in sizes)))).alias("gram"))
    common = held.join(offered.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    filed = offered.join(common, "gram").groupBy(key).agg(F.count("*").alias("k"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    grams_of = offered.groupBy(key).agg(F.count("*").alias("all"))
    filed = filed.join(grams_of, key).where(F.col("k") == F.col("all")).select(key, "gram")  # a needle with a gram that no text has is in none
    candidates = held.join(filed, "gram").select(at, key)
    joined = candidates.join(needles, key).join(texts, at)
    return joined.where(F.contains(F.col(text), F.col(needle))).select(*(f"`{c}`" for c in [*texts.columns, *needles.columns] if c not in (at, key)))
