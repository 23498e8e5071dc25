"""Rule ladders: policy selection, source alignment, statement parsing, agreement gates, representative cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.running import place_within

#: Verbs of anchored statements, in the order in which they are tried.
STATEMENT_VERBS = (
    ("IMPROVES", r"(?:significantly\s+)?(?:improves?|enhances?|boosts?)"),
    ("REDUCES", r"(?:significantly\s+)?(?:reduces?|decreases?|lowers?|suppresses?|mitigates?)"),
    ("INCREASES", r"(?:significantly\s+)?(?:increases?|raises?|extends?|broadens?)"),
    ("PROMOTES", r"(?:leads? to|results? in|causes?|drives?|induces?|enables?|facilitates?|promotes?)"),
    ("INHIBITS", r"(?:prevents?|inhibits?|hinders?)"),
    ("ASSOCIATED_WITH", r"(?:is|are|was|were)\s+(?:strongly\s+)?(?:associated|correlated)\s+with"),
    ("ATTRIBUTED_TO", r"(?:is|are|was|were)\s+attributed\s+to"),
)


#: What a statement may begin with before what it states; and the trimming of its sides, in this order.
STATEMENT_PREFIX = r"(?i)^(?:the\s+(?:study|work|paper|authors?)\s+(?:shows?|demonstrates?|reveals?|finds?|reports?|suggests?|indicates?|highlights?|concludes?|interprets?)\s+(?:that\s+)?|results?\s+(?:show|indicate)\s+(?:that\s+)?)"
SIDE_TAIL, SIDE_HEAD, SIDE_MODAL = r"(?i)\s*,\s*(?:as|which|while|because|due to|with)\b.*$", r"(?i)^(?:that|the)\s+", r"(?i)\s+(?:can|may|could)$"


def parse_statement(text: Column, verbs: Sequence[tuple[str, str]] = STATEMENT_VERBS, subject_words: tuple[int, int] = (2, 24), object_words: tuple[int, int] = (2, 30)) -> Column:
    """A struct (subject, relation, object) by the first verb that fits with sides of so many words; null if none does."""
    whole = F.regexp_replace(F.btrim(text, F.lit(" .;:-")), STATEMENT_PREFIX, "")

    def phrase(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(F.btrim(c, F.lit(" .;:-")), STATEMENT_PREFIX, ""), SIDE_TAIL, "")
        c = F.regexp_replace(F.regexp_replace(c, SIDE_HEAD, ""), SIDE_MODAL, "")
        return F.substring(F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .;:-")), 1, 180)

    found = []
    for relation, verb in verbs:
        pattern = rf"(?i)^(.+?)\s+{verb}\s+(.+)$"
        a, b = phrase(F.regexp_extract(whole, pattern, 1)), phrase(F.regexp_extract(whole, pattern, 2))
        fits = whole.rlike(pattern) & F.size(F.split(a, " ")).between(*subject_words) & F.size(F.split(b, " ")).between(*object_words)
        found.append(F.when(fits, F.struct(a.alias("subject"), F.lit(relation).alias("relation"), b.alias("object"))))
    return F.coalesce(*found)


def specific(text: Column, generic: Sequence[str], lengths: tuple[int, int] = (3, 95)) -> Column:
    return F.coalesce(F.length(text).between(*lengths) & ~F.lower(text).rlike("^(?:" + "|".join(generic) + ")"), F.lit(False))


#: Policies that every task is scored by.
MOST_POLICIES = 1000


def select_policies(tasks: DataFrame, policies: DataFrame, task: str, text: str, top: int = 1) -> DataFrame:
    """policies(policy, agent_prior, keywords array, priors map by task kind): the best by agent prior + task prior + min(1.25, 0.18 x keyword hits).

    tasks need a column `kind`. The table of policies is a fixed library, broadcast after it has been counted; more than
    MOST_POLICIES are an error. Confidence is 0.5 + 0.45 x score over the sum of all scores of the task.
    """
    if policies.limit(MOST_POLICIES + 1).count() > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    policies = F.broadcast(policies)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.size(F.filter("keywords", lambda k: low.contains(k)))
    scored = tasks.crossJoin(policies).select(task, "policy", (F.col("agent_prior") + F.coalesce(F.element_at("priors", F.col("kind")), F.lit(0.0)) + F.least(F.lit(1.25), 0.18 * hits)).alias("score"))
    w = Window.partitionBy(task)
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "policy")).cast("long")).withColumn("confidence", 0.5 + 0.45 * F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(w)), F.lit(0.0)))
    return ranked.where(F.col("rank") <= top)


def weighted_failures(events: DataFrame, key: str, kind: str, weights: Mapping[str, int], least: int) -> DataFrame:
    """(key, weight, kinds) of keys whose failures weigh at least so much."""
    w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col(kind)), F.lit(0))
    s = events.groupBy(key).agg(F.sum(w).alias("weight"), F.array_sort(F.collect_set(F.when(w > 0, F.col(kind)))).alias("kinds"))
    return s.where(F.col("weight") >= least)


def settings_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of settings that differ, over the union of keys."""
    j = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


def representative_cases(df: DataFrame, key: str, masks: Mapping[str, Column], per_mask: int = 3, most: int = 8) -> DataFrame:
    """The first rows of each mask, then of the next, each row once, at most so many in all."""
    tags = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("priority"), F.lit(name).alias("mask"))) for k, (name, c) in enumerate(masks.items()))))
    each = df.select(key, F.explode(tags).alias("t")).select(key, "t.*")
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("priority").orderBy(key))).where(F.col("_r") <= per_mask)
    once = ranked.groupBy(key).agg(F.min(F.struct("priority", "mask")).alias("m")).select(key, "m.*")  # at most per_mask rows a mask
    return once.orderBy("priority", key).limit(most)


def beeswarm_offsets(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, bin, offset): alternating places around the middle of value bins, scaled by the densest bin."""
    s = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    bins = max(12, min(42, int(2.8 * (s["n"] or 0) ** 0.5)))
    width = (s["hi"] - s["lo"]) if s["n"] else 0
    b = (F.floor((F.col(value) - s["lo"]) / width * (bins - 1)) if width else F.lit(0)).cast("long")
    placed = df.where(F.col(value).isNotNull()).select(key, b.alias("bin"))
    k = F.col("_place")
    counts = placed.groupBy("bin").agg(F.count("*").alias("c")).agg(F.max("c").alias("densest"))  # one row
    side = F.when(k % 2 == 0, F.floor(k / 2)).otherwise(-F.floor(k / 2)).cast("double")
    return place_within(placed, "bin", key).withColumn("_side", side).crossJoin(F.broadcast(counts)).select(key, "bin", F.try_divide(F.col("_side"), F.col("densest")).alias("offset"))


def promote_numeric(df: DataFrame, columns: Sequence[str], least_share: float = 0.8, least: int = 20) -> dict[str, bool]:
    """Which text columns hold numbers: whole values of enough rows and of enough of the present ones; one pass, one row to the driver."""
    from granary.functions.normalize import is_present

    whole = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*%?\s*$"
    row = df.agg(*(F.struct(F.count_if(is_present(c)).alias("n"), F.count_if(is_present(c) & F.col(c).rlike(whole)).alias("k")).alias(c) for c in columns)).first()
    return {c: row[c]["k"] >= max(least, least_share * row[c]["n"]) and row[c]["n"] > 0 for c in columns}


#: Features whose groups every task holds, and rows that one task sums.
MOST_FEATURES, ROWS_AT_ONCE = 100_000, 500_000


def grouped_attribution(values: DataFrame, groups: DataFrame, row: str, feature: str, value: str, cluster: str) -> DataFrame:
    """(group, mean_abs, balanced_mean_abs): values(row, cluster, feature, value) summed by the group of each feature, then the mean of absolute sums over rows, and over clusters' means.

    Fails if a feature has no group or several. Rows are dealt to tasks by row and cluster before they are summed, so that
    a task sums so many and no more, however large the table is or the pieces in which it is read.
    """
    n = F.count("*").over(Window.partitionBy(feature))
    checked = groups.withColumn("_ok", F.assert_true(n == 1, F.lit("a feature in several groups"))).where("_ok is null").drop("_ok")
    if groups.limit(MOST_FEATURES + 1).count() <= MOST_FEATURES:  # else features are many enough to be shuffled by
        checked = F.broadcast(checked)
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-values.count() // ROWS_AT_ONCE))
    j = values.join(checked, feature, "left").withColumn("_ok", F.assert_true(F.col("group").isNotNull(), F.lit("a feature without a group"))).where("_ok is null")
    sums = j.select(row, cluster, "group", value).repartition(tasks, row, cluster).groupBy(row, cluster, "group").agg(F.abs(F.sum(value)).alias("a"))
    by = sums.groupBy(cluster, "group").agg(F.sum("a").alias("s"), F.count("*").alias("n"))
    return by.groupBy("group").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean_abs"), F.avg(F.col("s") / F.col("n")).alias("balanced_mean_abs"))


def agreement_gate(df: DataFrame, a: str, b: str, least_spearman: float = 0.9, most_relative_error: float = 0.25) -> DataFrame:
    """(spearman, pearson, relative_mae, passed) of an approximation b of a."""
    from granary.operators.metrics import spearman

    s = spearman(df, a, b).select("spearman")
    m = df.agg(F.corr(a, b).alias("pearson"), F.try_divide(F.avg(F.abs(F.col(b) - F.col(a))), F.avg(F.abs(F.col(a)))).alias("relative_mae"))
    return s.crossJoin(F.broadcast(m)).withColumn("passed", (F.col("spearman") >= least_spearman) & (F.col("relative_mae") <= most_relative_error))  # one row each


def json_paths(df: DataFrame, key: str, text: str, depth: int | None = None) -> DataFrame:
    """(key, path, value): the scalars of a JSON text by dotted path, list places from 0; all levels, or down to a depth below which it stays JSON text. Broken texts have no rows."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    out, k = None, 0
    while out is None or depth is not None and k <= depth or depth is None and not level.isEmpty():
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        done = level if k == depth else level.where(~nested)
        leaf = done.select(key, F.substring("path", 2, 1 << 20).alias("path"), F.when(nested, F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))
        out = leaf if out is None else out.union(leaf)
        level, k = _exploded(level.where(nested), key), k + 1
    return out


def _exploded(level: DataFrame, key: str) -> DataFrame:
    step = "select `{}`, concat(path, '.', coalesce(e.key, cast(e.pos as string))) as path, e.value as v from {{level}}, lateral variant_explode(v) as e".format(key)
    return level.sparkSession.sql(step, level=level)
