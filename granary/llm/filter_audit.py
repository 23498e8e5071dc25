"""What each filter of a chain removes, in every order, from counts over the lattice of filter subsets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import WORD, materialize, quoted, table

LETTERS = "ABCDE"
#: Limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
MARKS = r"[#$%&*|]"
#: The table of orders has a row for each order and step: 5,040 orders of seven filters, and every part has a row for each.
MOST_FILTERS = 7


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, weight) of every edge: filter is applied after those in state, in `weight` of the n! orders.

    A forward pass counts the orders that reach a state, a backward pass those that leave it for the full set; an edge
    lies on as many orders as reach its start times as many as leave its end.
    """
    states = range(1 << n)
    ahead, behind = [1] + [0] * ((1 << n) - 1), [0] * ((1 << n) - 1) + [1]
    for s in states:  # a subset is a smaller number than its supersets
        for f in range(n):
            if not s >> f & 1:
                ahead[s | 1 << f] += ahead[s]
    for s in reversed(states):
        for f in range(n):
            if not s >> f & 1:
                behind[s] += behind[s | 1 << f]
    return [(s, f, ahead[s] * behind[s | 1 << f]) for s in states for f in range(n) if not s >> f & 1]


def audit_filters(flagged: DataFrame, fails: Sequence[str], part: str = "part", marks: Sequence[str] = (), letters: str = LETTERS) -> DataFrame:
    """For each value of `part`, each order of the filters and each step of it, what the step's filter removes.

    flagged: a row for each document, with boolean columns `fails` (null: false), one for each filter, and boolean
    columns `marks`. Returns part, filter_order, step (from 1), kept, removed, redundant, unique_fails, <mark>_lost for
    each mark, and shapley (removals summed over all orders), zeros included.

    Documents become one count for each part and set of failed filters before the only shuffle of theirs, so a part
    that holds most rows is no hot key. An edge of the lattice has all counts of a step, whatever the order that led
    there; orders read their steps from the edges. Repeated rows count each; null parts are a part; an empty table has
    no part, hence no row. Other columns of flagged, whatever their names, are not read.
    """
    n = len(fails)
    if not 0 < n <= MOST_FILTERS or n > len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, and a letter for each")
    spark = flagged.sparkSession
    failed = sum((F.coalesce(quoted(c), F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(fails)), F.lit(0))
    picked = flagged.select(quoted(part).alias("part"), failed.alias("failed"), *(F.coalesce(quoted(m), F.lit(False)).cast("long").alias(f"m{k}") for k, m in enumerate(marks)))
    counts = picked.groupBy("part", "failed").agg(F.count("*").alias("n"), *(F.sum(f"m{k}").alias(f"m{k}") for k in range(len(marks))))

    edges = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("filter"), F.lit(w).cast("long").alias("weight")) for s, f, w in lattice(n)))
    has, before = F.col("failed").bitwiseAND(F.col("filter")) != 0, F.col("failed").bitwiseAND(F.col("state")) != 0
    count = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    steps = counts.select("*", F.inline(edges)).groupBy("part", "state", "filter", "weight").agg(  # n * 2^(n-1) edges for each of at most 2^n counts of a part
        count("n", ~has & ~before).alias("kept"), count("n", has & ~before).alias("removed"), count("n", has & before).alias("redundant"),
        count("n", F.col("failed") == F.col("filter")).alias("unique_fails"), *(count(f"m{k}", has & ~before).alias(f"lost{k}") for k in range(len(marks))),
    )
    steps = steps.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(Window.partitionBy("part", "filter")))
    walks = [("".join(letters[f] for f in order), k + 1, sum(1 << g for g in order[:k]), 1 << f) for order in permutations(range(n)) for k, f in enumerate(order)]
    walks = F.broadcast(spark.createDataFrame(walks, "filter_order string, step int, state int, filter int"))  # n * n! rows
    return walks.join(steps, ["state", "filter"]).select(
        F.col("part").alias(part), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(F.col(f"lost{k}").alias(f"{m}_lost") for k, m in enumerate(marks)), "shapley"
    )


def failures(docs: DataFrame) -> dict[str, Column]:
    """The conditions on a text alone (null: empty) under which filters A to D remove a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct.cast("long") < LEAST_DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part (source, null: empty), A to E and whether labels call the document good or toxic.

    E: another row with a smaller doc_id has the same text, wherever it is and whatever removes it. Rows that share the
    smallest id don't fail; a row without an id fails nothing by E and fails nobody else's. Null and empty texts are
    equal. If labels has several rows of an id, one that says so is enough; rows without an id have no labels.

    Texts are read once: they become flags and a SHA-256, written in the shared folder. Hashes are grouped after being
    combined in each task; only those that occur twice are joined back, which Spark broadcasts if it measures few and
    splits if one is hot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = materialize(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("hash"), *(c.alias(k) for k, c in failures(docs).items())), "flags")
    twice = seen.groupBy(F.col("hash").alias("_hash")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = seen.join(twice, F.col("hash") == F.col("_hash"), "left").join(said, F.col("doc_id") == F.col("_id"), "left")
    return marked.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False)).alias("E"), "good", "toxic")


def op11_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit_filters(flagged, list(LETTERS), marks=("good", "toxic"))


OP11_SQL = rf"""
with recursive d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents
), f as (
    select doc_id, part,
        case when len(w) < {LEAST_WORDS} then 'A' else '' end || case when 100 * len(list_distinct(w)) < {LEAST_DISTINCT_PERCENT} * len(w) then 'B' else '' end
        || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(t) then 'C' else '' end
        || case when regexp_matches(t, '{MARKS}') then 'D' else '' end || case when min(doc_id) over (partition by t) < doc_id then 'E' else '' end as fails
    from d
), l as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1
), n as (
    select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by 1, 2
), walk as (
    select '' as done, '{LETTERS}' as rest
    union all
    select done || x, replace(rest, x, '') from (select done, rest, unnest(string_split(rest, '')) as x from walk where rest <> '')
), o as (
    select done as filter_order, step::int as step, substr(done, step, 1) as f, substr(done, 1, step - 1) as earlier from walk, range(1, {len(LETTERS) + 1}) s(step) where rest = ''
), r as (
    select part, filter_order, step, f, n.n, good, toxic, fails = f as alone, contains(fails, f) as has, translate(fails, earlier, '') <> fails as gone from n, o
), c as (
    select part, filter_order, step, f, sum(case when not has and not gone then n else 0 end)::bigint as kept, sum(case when has and not gone then n else 0 end)::bigint as removed,
        sum(case when has and gone then n else 0 end)::bigint as redundant, sum(case when alone then n else 0 end)::bigint as unique_fails,
        sum(case when has and not gone then good else 0 end)::bigint as good_lost, sum(case when has and not gone then toxic else 0 end)::bigint as toxic_lost
    from r group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from c
"""
