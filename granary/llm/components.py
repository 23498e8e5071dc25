"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import finished, materialize


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """links(a, b) -> (node, component): every node that occurs in a link, with the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so chains
    shorten by half or better; the labels of a round are a written table in the shared folder. Sums and minima are
    combined before every shuffle, so a node with very many links is no hot key; rows with a null end are ignored.
    """
    return finished(lambda: _settled(links, max_rounds), "components")


def _settled(links: DataFrame, max_rounds: int) -> DataFrame:
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        heads = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        new = materialize(stepped.join(heads, "to").select("node", "was", F.least("to", "jump").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
