"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import carried, materialize, quoted, set_aside, small_or_plain, table

SEED = 17
#: Without given weights a source's target weight is its share of the bytes to this power, so large sources lose and small ones gain.
TEMPERATURE = 0.7
#: Copies are drawn at once up to this rate; a higher rate is the sum of several draws, which OP10_SQL doesn't state (no source of the test data has one).
MAX_RATE = 16.0
#: Beyond this many copies the chance is under 2^-53 for one draw.
MOST_COPIES = 64
#: The shuffled order is cut into this many equal ranges of its key.
RANGES = 1 << 16
#: A table of rates is broadcast up to this many sources; beyond it Spark joins by shuffle and splits a hot source.
BROADCAST_SOURCES = 50_000


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: Column | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): how often a document of a source is to occur on average so that the mixture has the target weights and the size of the input.

    size: what is weighed, by default the UTF-8 bytes of the text and one more. weights: by source, not all zero; a
    source that has none gets none. Null sources are a source of their own.
    """
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1 if size is None else size
    sums = materialize(docs.groupBy("source").agg(F.sum(size.cast("long")).alias("_size")), "sources")
    if weights is None:
        weighed = sums.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, _weight double")
        weighed = sums.join(given.withColumnRenamed("source", "_source"), sums.source.eqNullSafe(F.col("_source")), "left").drop("_source").na.fill(0.0, ["_weight"])
    total = weighed.agg(F.sum("_size").alias("size"), F.sum("_weight").alias("weight")).first()
    if not total["size"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    if not total["weight"]:
        raise ValueError("no source that occurs has a weight")
    rate = F.col("_weight") / F.lit(float(total["weight"])) * F.lit(float(total["size"])) / F.col("_size")
    return weighed.select("source", rate.alias("rate"))


def poisson_steps(rate: Column, most: int = MOST_COPIES) -> Column:
    """The distribution function of a Poisson law at 0, 1, ..., most, as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, add, lambda acc: acc["steps"])


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE, ranges: int = RANGES) -> DataFrame:
    """Every document as often as a Poisson law with its source's rate says, in one global shuffled order.

    The law is inverted at a number in [0, 1) that a hash of seed and doc_id gives (rows without an id: of their text),
    so a rerun, or a lost executor, gives the same rows. Adds rate, n_copies, copy (from 0) and position, gapless from 0
    in the shuffled order; all other columns of docs stay, those with these four names give way. Rows are dealt by ranges of a hash of seed, id and copy, so neither
    a hot source nor a group of copies meets in one task; only one count for each range reaches the driver. Null sources
    are a source; null texts count as empty; rows that are equal throughout are repeated independently of their place.
    An empty table gives an empty result.
    """
    docs = docs.select(*map(quoted, carried(docs.columns, ("rate", "n_copies", "copy", "position"))))
    docs, back = set_aside(docs, "doc_id", "text", "source")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int"))
    rates = source_rates(docs, weights, None, temperature).select(F.col("source").alias("_source"), "rate", draws.alias("_draws"), poisson_steps(F.col("rate") / draws).alias("_steps"))
    rates = small_or_plain(materialize(rates, "rates"), BROADCAST_SOURCES)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.coalesce("text", F.lit("")))))
    copies_at = lambda x: F.size(F.filter("_steps", lambda s: s <= F.conv(F.substring(F.md5(x), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))))
    # a sum of independent Poisson draws is a Poisson draw of the sum of their rates
    more = F.aggregate(F.sequence(F.lit(2), F.col("_draws")), F.lit(0), lambda n, k: n + copies_at(F.concat(key, F.lit(":draw"), k.cast("string"))))
    counted = docs.join(rates, docs.source.eqNullSafe(F.col("_source"))).withColumn("n_copies", copies_at(key) + F.when(F.col("_draws") > 1, more).otherwise(0))
    copies = (
        counted.drop("_source", "_draws", "_steps").where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("_key", F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long"))
        .withColumn("_range", F.floor(F.col("_key") / F.lit(float(1 << 60)) * ranges).cast("int"))
    )
    counts = {r["_range"]: r["count"] for r in copies.groupBy("_range").count().collect()}  # at most `ranges` rows
    starts, at = [], 0
    for k in sorted(counts):
        starts.append((k, at))
        at += counts[k]
    start = F.broadcast(docs.sparkSession.createDataFrame(starts, "_range int, _start long"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "doc_id", "copy")) - 1
    placed = copies.withColumn("_rank", rank).join(start, "_range").withColumn("position", (F.col("_start") + F.col("_rank")).cast("long"))
    return placed.select(*back, "rate", "n_copies", "copy", "position")


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "n_copies", "copy", "position", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP10_SQL = f"""
with recursive sums as (
    select source, sum(strlen(coalesce(text, '')) + 1)::bigint as size from documents group by source
), weighed as (
    select source, size, pow(size::double, {TEMPERATURE}) as weight from sums
), rates as (
    select source, weight / (select sum(weight) from weighed) * (select sum(size) from sums) / size as rate from weighed
), steps as (
    select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as step from rates
    union all
    select source, rate, k + 1, p * rate / (k + 1), step + p * rate / (k + 1) from steps where k < {MOST_COPIES}
), drawn as (
    select doc_id, source, text, '{SEED}:' || coalesce(doc_id::varchar, '-' || coalesce(text, '')) as key from documents
), counted as (
    select d.doc_id, d.source, d.key, any_value(d.text) as text, any_value(s.rate) as rate, count(*) filter (where s.step <= ('0x' || substr(md5(d.key), 1, 13))::bigint / {1 << 52}::double) as n
    from drawn d join steps s on s.source is not distinct from d.source group by d.doc_id, d.source, d.key
), copies as (
    select doc_id, source, text, rate, n, copy, ('0x' || substr(md5(key || ':' || copy), 1, 15))::bigint as place
    from (select *, unnest(range(0, n)) as copy from counted)
)
select c.doc_id, c.source, round(c.rate, 6) as rate, c.n::int as n_copies, c.copy::int as copy,
    row_number() over (order by c.place, c.doc_id, c.copy) - 1 as position, md5(coalesce(c.text, '')) as text_md5
from copies c
"""
