"""From raw documents to packed sequences, in five stages; each is written as Parquet and read again by the next.

Columns that documents has beside doc_id, text, lang and source pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import finished, forget, materialize, quoted, set_aside, table, unused
from granary.llm.components import connected_components
from granary.llm.language import UNKNOWN, learn_profiles, predict_languages
from granary.llm.minhash import PERCENT, WORDS, near_duplicates
from granary.llm.mixing import mix_sources
from granary.llm.packing import pack_documents
from granary.llm.quality import quality_verdicts

#: Documents whose language is recognised with less than this, or not at all, go.
LEAST_SCORE = 0.15
#: Near-duplicates share at least so many hundredths of their shingles of so many words, by either rule: the first finds
#: appended text, the second scattered edits.
RULES = ((5, 80), (WORDS, PERCENT))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs, back = set_aside(docs, "doc_id", "text", "lang")
    return quality_verdicts(docs).where("kept").select(*back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; lang becomes the predicted one. Profiles are learned from the stage's own input."""
    docs, back = set_aside(docs, "doc_id", "text", "lang")
    found = predict_languages(docs, learn_profiles(docs, F.lit(True)))
    recognised = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return recognised.withColumn("lang", F.col("lang_pred")).select(*back)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, or any one if several share it or none has one.

    Rows are told apart by a number of their own, so copies that repeat a doc_id or have none are copies like others.
    Rows without text or words are no copies of each other.
    """
    row = unused("_row", docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = [F.col("doc_id").alias("a"), F.col("component_id").alias("b")]
    found = [finished(lambda w=w, p=p: near_duplicates(rows, key=row, width=w, percent=p).where("doc_id <> component_id").select(linked), "linked") for w, p in RULES]
    groups = connected_components(found[0].union(found[1]))
    ids = groups.join(rows.select(F.col(row).alias("node"), "doc_id"), "node")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")).select("first.node")
    gone = groups.join(first, "node", "left_anti").select(F.col("node").alias(row))
    return rows.join(gone, row, "left_anti").select(*map(quoted, docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight says, in a global shuffled order."""
    docs, back = set_aside(docs, "doc_id", "text", "source")
    return mix_sources(docs).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs, ["doc_id"])


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", minhash_dedup), ("mixing sources to target weights", mixing), ("best-fit packing", best_fit_packing)]

#: MinHash links and token ids are nothing that SQL can express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
        forget(before)
    return docs
