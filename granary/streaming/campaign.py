"""Incremental batches: a registry of processed keys, a ledger of counts, and windows over event streams (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming import StreamingQuery

from granary.operators.identity import keep_first


def query_plan(targets: Sequence[str], sweep: Sequence[str], most: int = 0) -> list[str]:
    """Distinct queries in order, compared without case and extra spaces; at most `most` if it is positive."""
    seen: dict[str, str] = {}
    for q in [*targets, *sweep]:
        seen.setdefault(" ".join(q.lower().split()), q)
    plan = [q for key, q in seen.items() if key]
    return plan[:most] if most > 0 else plan


def process_batch(registry_path: str, key: str, order: Sequence[str], out_path: str):
    """For foreachBatch: rows whose key was never seen are appended, and registered with their batch.

    A batch that is run again after a failure finds its own keys registered under its own number and writes nothing
    twice: rows are chosen against keys of other batches, and both tables are partitioned by batch and overwritten.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        firsts = keep_first(batch.where(F.col(key).isNotNull()), [key], order)
        try:
            known = spark.read.parquet(registry_path).where(F.col("batch") != batch_id).select(key)
            firsts = firsts.join(known, key, "left_anti")
        except Exception as e:  # no registry yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new = firsts.withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            for path, df in ((out_path, new), (registry_path, new.select(key, "batch"))):
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            new.unpersist()

    return run


def start_campaign(stream: DataFrame, key: str, order: Sequence[str], registry_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(process_batch(registry_path, key, order, out_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidate_accounting(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(new, gone, kept) distinct keys of two rounds."""
    a, b = previous.select(key).distinct().withColumn("a", F.lit(1)), current.select(key).distinct().withColumn("b", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("a").isNull()).alias("new"), F.count_if(F.col("b").isNull()).alias("gone"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


def ledger_deltas(ledger: DataFrame, batch: str, counts: Sequence[str]) -> DataFrame:
    """The ledger of cumulative counts with each batch's own share; a ledger has one row for each batch."""
    w = Window.orderBy(batch)
    return ledger.withColumns({f"{c}_delta": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counts})


def next_batch(ledger: DataFrame) -> int | None:
    """The latest batch without an end, to be resumed."""
    row = ledger.where("finished is null").agg(F.max("batch")).first()
    return row[0]


def targets_met(papers: int, ready: int, wanted_papers: int, wanted_ready: int) -> bool:
    """A campaign goes on until both counts are reached."""
    return papers >= wanted_papers and ready >= wanted_ready


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Tumbling counts with a watermark; the same for a stream and a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), by, "events")


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


class Campaign:
    """Rounds over a plan of queries until enough papers and model-ready records are known, attempts run out, or the plan ends.

    collect(query, round) gives the candidates of one query: key, ready (boolean) and any other columns. A round takes
    the next `per_round` queries; its rows whose key no earlier round had are written under its number, then its ledger
    row is. Both are partitioned by round and overwritten, so a round that was cut off is done again and counts once; a
    new Campaign at the same path goes on where the ledger ends.
    """

    def __init__(self, spark: SparkSession, path: str, plan: Sequence[str], wanted_papers: int, wanted_ready: int, most_rounds: int = 0, per_round: int = 1):
        self.spark, self.path, self.plan = spark, path, list(plan)
        self.wanted_papers, self.wanted_ready, self.most_rounds, self.per_round = wanted_papers, wanted_ready, most_rounds, max(1, per_round)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(round, queries, candidates, added, papers, ready), papers and ready so far."""
        return self._read("ledger", "queries long, candidates long, added long, papers long, ready long, round int")

    def found(self) -> DataFrame:
        return self._read("found", "key string, ready boolean, round int")

    def run(self, collect) -> str:
        """Why the campaign stopped: targets_met, attempts_exhausted or plan_exhausted."""
        last = self.ledger().orderBy(F.desc("round")).first()
        done, papers, ready = (last["round"] + 1, last["papers"], last["ready"]) if last else (0, 0, 0)
        used = self.ledger().agg(F.coalesce(F.sum("queries"), F.lit(0))).first()[0]
        while True:
            if targets_met(papers, ready, self.wanted_papers, self.wanted_ready):
                return "targets_met"
            if self.most_rounds and done >= self.most_rounds:
                return "attempts_exhausted"
            queries = self.plan[used : used + self.per_round]
            if not queries:
                return "plan_exhausted"
            parts = [collect(q, done) for q in queries]
            rows = parts[0]
            for more in parts[1:]:
                rows = rows.unionByName(more)
            rows = rows.where("key is not null").persist()
            known = self.found().where(F.col("round") < done).select("key")
            firsts = keep_first(rows, ["key"], [c for c in rows.columns if c != "key"]).join(known, "key", "left_anti")
            write = lambda df, name: df.withColumn("round", F.lit(done)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(f"{self.path}/{name}")  # noqa: E731, B023
            write(firsts, "found")
            own = self.found().where(F.col("round") == done).agg(F.count("*").alias("n"), F.count_if("ready").alias("ready")).first()
            papers, ready, n = papers + own["n"], ready + own["ready"], rows.count()
            rows.unpersist()
            write(self.spark.createDataFrame([(len(queries), n, own["n"], papers, ready)], "queries long, candidates long, added long, papers long, ready long"), "ledger")
            done, used = done + 1, used + len(queries)
