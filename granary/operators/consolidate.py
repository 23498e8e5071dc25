"""Papers out of records that name them by one or several identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import clean
from granary.operators.components import linked_groups
from granary.sources.shared import written


def paper_groups(records: DataFrame, row: str, ids: Mapping[str, Column]) -> DataFrame:
    """(row, paper): records that share an identifier of one kind, directly or over others, are one paper, named by its smallest identifier.

    ids: by kind, normalised, null or empty where a record has none. Identifiers of a record are linked to its first, so
    an identifier that very many records have is one node; only identifiers are grouped, and records take the group of
    their first one. Records without any are papers of their own, named by their row.
    """
    named = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{kind}:"), c)) for kind, c in ids.items()]
    keyed = written(records.select(F.col(row), F.array_compact(F.array(*named)).alias("_ids")), "identifiers")
    links = keyed.where(F.size("_ids") > 0).select(F.element_at("_ids", 1).alias("a"), F.explode("_ids").alias("b")).distinct()
    groups = linked_groups(links).withColumnRenamed("id", "_id")
    first = keyed.select(row, F.try_element_at("_ids", F.lit(1)).alias("_first"))
    named = first.where("_first is not null").join(groups, F.col("_first") == F.col("_id")).select(row, F.col("group").alias("paper"))
    return named.union(first.where("_first is null").select(row, F.concat(F.lit("row:"), F.col(row).cast("string"))))


def consolidate_papers(
    records: DataFrame, row: str, ids: Mapping[str, Column], order: str, scalars: Sequence[str] = (), longest: Sequence[str] = (), sets: Sequence[str] = (), flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """A row for each paper of paper_groups(), by consolidate_groups(); row must tell records apart."""
    return consolidate_groups(records.join(paper_groups(records, row, ids), row), "paper", row, order, scalars, longest, sets, flags)


def consolidate_groups(
    records: DataFrame, group: str, row: str, order: str, scalars: Sequence[str] = (), longest: Sequence[str] = (), sets: Sequence[str] = (), flags: Mapping[str, Column] | None = None, tidy: bool = True
) -> DataFrame:
    """A row for each group: raw_record_count, and of its records the first value by `order` of each of scalars, the longest of each of longest (of equal ones the first), the sorted different values of each of sets, and how many of them each of flags holds for.

    Equal places in the order go by row. Values are cleaned (if `tidy`), and empty ones don't count. All are aggregates
    that combine before the shuffle, so a group with very many records is no hot key; a set holds as many values as are
    different.
    """
    at = F.struct(F.col(order).alias("order"), F.col(row).alias("row"))
    text = (lambda c: clean(F.col(c))) if tidy else (lambda c: F.col(c).cast("string"))
    value = lambda c: F.when(F.length(text(c)) > 0, text(c))
    found = {c: F.min_by(value(c), F.when(value(c).isNotNull(), at)) for c in scalars}
    found |= {c: F.min_by(value(c), F.when(value(c).isNotNull(), F.struct((-F.length(value(c))).alias("size"), at.alias("at")))) for c in longest}
    found |= {c: F.array_sort(F.collect_set(value(c))) for c in sets} | {name: F.count_if(c) for name, c in (flags or {}).items()}
    grouped = records.groupBy(group).agg(F.count("*").alias("raw_record_count"), *(c.alias(f"_found{k}") for k, c in enumerate(found.values())))
    return grouped.withColumnsRenamed({f"_found{k}": name for k, name in enumerate(found)})
