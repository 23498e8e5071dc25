"""Connected components of links between any ids, in rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.shared import delete, shared_folder


def linked_groups(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links(a, b) -> (id, group): every id that occurs, with the smallest id that links reach from it.

    A round gives each id the smallest group among its own and its neighbours' and then that group's own group, so a
    chain of n ids needs about log n rounds. Minima are combined before each shuffle, so an id with very many links is no
    hot key. Rounds are written in the shared folder: a lost executor costs one round at most, and the plan stays short.
    A link with a null end makes its other end known, if any.
    """
    spark = links.sparkSession
    kept: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        kept.append(shared_folder(spark, "groups"))
        df.write.parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    ends = links.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a is not null")
    both = put(ends.union(ends.select("b", "a")).distinct())
    groups = put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("group")))
    for _ in range(max_rounds):
        near = both.join(groups, both.b == groups.id).groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = groups.join(near, "id").select("id", F.col("group").alias("was"), F.least("group", "near").alias("to"))
        heads = groups.select(F.col("id").alias("to"), F.col("group").alias("jump"))
        new = put(step.join(heads, "to").select("id", "was", F.least("to", "jump").alias("group")))
        groups = new.select("id", "group")
        if len(kept) > 3:
            delete(spark, kept.pop(-2))
        if new.where("`group` <> was").isEmpty():
            delete(spark, kept[0])
            return groups
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
