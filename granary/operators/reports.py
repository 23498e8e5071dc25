"""Comparisons, gates, audits and summaries that reports are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.normalize import MISSING, is_present
from granary.operators.running import running_before


def first_identity(identities: Mapping[str, Column]) -> Column:
    """`kind:value` of the first identity that is present."""
    return F.coalesce(*(F.when(is_present(c), F.concat(F.lit(f"{kind}:"), c.cast("string"))) for kind, c in identities.items()))


def distinct_by_first_identity(df: DataFrame, identities: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, papers, rows): how many different things the rows tell of, by the first identity that each has; rows without any count as rows only."""
    keyed = df.select(*by, first_identity(identities).alias("_id"))
    return keyed.groupBy(*by, "_id").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.count("_id").alias("papers"), F.sum("_n").alias("rows"))


def timing_summary(log: DataFrame, status: str, elapsed: str) -> DataFrame:
    """(status, count, elapsed_avg, elapsed_max) by status and, with a null status, of all; elapsed times that are no numbers are left out."""
    seconds = F.col(elapsed).cast("string").try_cast("double")
    sums = log.groupBy(F.coalesce(F.col(status).cast("string"), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"), F.count(seconds).alias("k"), F.max(seconds).alias("m"))
    both = sums.unionByName(sums.agg(F.lit(None).cast("string").alias("status"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.max("m").alias("m")))
    return both.select("status", F.col("n").alias("count"), F.round(F.try_divide("s", "k"), 3).alias("elapsed_avg"), F.round("m", 3).alias("elapsed_max"))


def matched_deltas(df: DataFrame, keys: Sequence[str], variant: str, before: str, after: str, metrics: Sequence[str]) -> DataFrame:
    """(keys, delta_<metric>): after less before, for keys that both variants have."""
    pick = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    both = F.bool_or(F.col(variant) == before) & F.bool_or(F.col(variant) == after)
    return df.groupBy(*keys).agg(both.alias("_both"), *((pick(after, m) - pick(before, m)).alias(f"delta_{m}") for m in metrics)).where("_both").drop("_both")


def support_gate(counts: DataFrame, dataset: str, target: str, n: str, before: str, after: str, checks: Mapping[str, tuple[Sequence[str], int]], more: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: for each check the largest gain in rows of its targets and whether it reaches the least; further checks on the sums of all rows; pass or review.

    counts(dataset, target, n); a target that a dataset lacks has no rows there.
    """
    rows = lambda d, t: F.coalesce(F.max(F.when((F.col(dataset) == d) & (F.col(target) == t), F.col(n))), F.lit(0))
    gains = {name: F.greatest(*(g := [rows(after, t) - rows(before, t) for t in targets]), *g[:1]) for name, (targets, _) in checks.items()}
    wide = counts.agg(*(g.alias(f"{name}_added") for name, g in gains.items()), *(c.alias(f"{name}_ok") for name, c in (more or {}).items()))
    wide = wide.withColumns({f"{name}_ok": F.col(f"{name}_added") >= least for name, (_, least) in checks.items()})
    every = [F.coalesce(F.col(f"{name}_ok"), F.lit(False)) for name in [*checks, *(more or {})]]
    return wide.withColumn("decision", F.when(F.array_min(F.array(*every)), "pass").otherwise("review"))


def latest_status(log: DataFrame, registry: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """(key, status): the last status of the log, and `registry_only` for what only the registry knows."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(status, order).alias("status"))
    unseen = registry.select(key).where(F.col(key).isNotNull()).distinct().join(last.select(key), key, "left_anti")
    return last.unionByName(unseen.withColumn("status", F.lit("registry_only")))


def variant_summaries(df: DataFrame, variants: Mapping[str, Column], summary: Sequence[Column]) -> DataFrame:
    """One row of the summary for each variant, a variant being the rows that its condition holds for; one pass for all."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in variants.items())))
    return df.withColumn("variant", F.explode(names)).groupBy("variant").agg(*summary)


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, q1, median, q3, high) with linear (type 7) quantiles."""
    at = F.percentile(value, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75))))
    s = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("low"), at.alias("q"), F.max(value).alias("high"))
    return s.select(group, "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def fill_rate_shift(df: DataFrame, cohort: Column, columns: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """(column, base_rate, added_rate, change, abs_change): the share of present values in rows with cohort false and true."""
    added = F.coalesce(cohort, F.lit(False))
    wide = df.agg(F.count_if(added).alias("_a"), F.count_if(~added).alias("_b"), *(x for c in columns for x in (F.count_if(is_present(c, missing) & added).alias(f"a_{c}"), F.count_if(is_present(c, missing) & ~added).alias(f"b_{c}"))))
    rate = lambda c, side: F.try_divide(F.col(f"{side}_{c}").cast("double"), F.col(f"_{side}"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), rate(c, "b").alias("base_rate"), rate(c, "a").alias("added_rate")) for c in columns)))
    change = F.col("added_rate") - F.col("base_rate")
    return wide.select(each.alias("e")).select("e.*", change.alias("change"), F.abs(change).alias("abs_change"))


def top_share(df: DataFrame, value: str, key: str, share: int = 4) -> DataFrame:
    """(key): the rows with the largest values, one of `share` of those that have one but at least one; of equal values those with the smallest keys.

    How many rows are above a value comes from running sums over counts of distinct values; only the value at the
    border is looked at by key. Keys are unique.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, (-F.col(value)).alias("_v"))
    counts = running_before(rows.groupBy("_v").agg(F.count("*").alias("_n")), "_v", ["_n"])
    most = rows.count() // share or 1
    edge = counts.where((F.col("_n_before") < most) & (F.col("_n_before") + F.col("_n") > most)).first()
    above = rows.join(counts.where(F.col("_n_before") + F.col("_n") <= most).select("_v"), "_v", "left_semi").select(key)
    if edge is None:
        return above
    tied = running_before(rows.where(F.col("_v") == edge["_v"]).select(key, F.lit(1).alias("_one")), key, ["_one"])
    return above.union(tied.where(F.col("_one_before") < most - edge["_n_before"]).select(key))


def top_overlap(df: DataFrame, key: str, base: str, other: str, share: int = 4) -> DataFrame:
    """(n_base, shared, overlap): which part of the base's top rows are top rows of the other value too, among rows that have both."""
    a, b = top_share(df.where(F.col(base).isNotNull()), base, key, share), top_share(df.where(F.col(base).isNotNull() & F.col(other).isNotNull()), other, key, share)
    return a.join(b.withColumn("_in", F.lit(1)), key, "left").agg(F.count("*").alias("n_base"), F.count("_in").alias("shared")).withColumn("overlap", F.try_divide(F.col("shared").cast("double"), F.col("n_base")))


def disagreements(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """df with one flag `disagree_<name>` for each pair of reviewers' columns, and `disagreement` if any differs; two missing values agree."""
    flags = {f"disagree_{name}": ~F.lower(F.trim(F.col(a).cast("string"))).eqNullSafe(F.lower(F.trim(F.col(b).cast("string")))) for name, (a, b) in pairs.items()}
    return df.withColumns(flags).withColumn("disagreement", F.array_max(F.array(*(F.col(x) for x in flags))))


def invalid_values(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column, value, rows): present values that a column's vocabulary doesn't have; one row for each."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.when(is_present(c) & ~F.col(c).cast("string").isin(list(values)), F.col(c).cast("string")).alias("value")) for c, values in allowed.items())))
    return df.select(cells.alias("c")).select("c.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows"))


def golden_differences(got: DataFrame, want: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(key, column, got, want): cells that differ by more than the tolerance (numbers) or at all, and rows that one side lacks."""
    numeric = {f.name for f in got.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    j = got.select(key, F.struct(*columns).alias("g")).join(want.select(key, F.struct(*columns).alias("w")), key, "full_outer")
    cells = []
    for c in columns:
        a, b = F.col(f"g.{c}"), F.col(f"w.{c}")
        same = a.eqNullSafe(b) | (F.abs(a - b) <= tolerance if c in numeric else F.lit(False))
        cells.append(F.when(~F.coalesce(same, F.lit(False)), F.struct(F.lit(c).alias("column"), a.cast("string").alias("got"), b.cast("string").alias("want"))))
    lacking = F.when(F.col("g").isNull() | F.col("w").isNull(), F.array(F.struct(F.lit("<row>").alias("column"), F.when(F.col("g").isNotNull(), "present").alias("got"), F.when(F.col("w").isNotNull(), "present").alias("want"))))
    return j.select(key, F.explode(F.coalesce(lacking, F.array_compact(F.array(*cells)))).alias("d")).select(key, "d.*")


def value_fingerprint(df: DataFrame, columns: Sequence[str], digits: int = 12) -> DataFrame:
    """(rows, fingerprint): the same for the same rows in any order; numbers are written with so many digits after the point."""
    text = [F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("string"), F.lit("<null>")) for c in columns]
    part = lambda at: F.sum(F.conv(F.substring(F.col("_h"), at, 12), 16, 10).cast("decimal(38,0)"))
    hashed = df.select(F.sha2(F.concat_ws("\x1f", *text), 256).alias("_h"))
    return hashed.agg(F.count("*").alias("rows"), F.concat_ws("-", *(F.coalesce(part(at), F.lit(0)).cast("string") for at in (1, 13, 25, 37))).alias("fingerprint"))


def table_contracts(df: DataFrame, contracts: Mapping[str, Column]) -> DataFrame:
    """(contract, passed) for conditions over a whole table, all in one pass; what can't be said (null) hasn't passed."""
    wide = df.agg(*(F.coalesce(c, F.lit(False)).alias(name) for name, c in contracts.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(name).alias("contract"), F.col(name).alias("passed")) for name in contracts))).alias("c")).select("c.*")


def priority_mapping(df: DataFrame, maps: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """df with mapped_to and mapped_by: what the first of the maps (frame, key, value, name) that knows the row says; both null where none does.

    A map's keys are unique; a row without a key isn't looked up.
    """
    out = df
    for k, (frame, key, value, _) in enumerate(maps):
        out = out.join(frame.where(F.col(key).isNotNull()).select(key, F.col(value).alias(f"_to{k}")), key, "left")
    first = F.coalesce(*(F.when(F.col(f"_to{k}").isNotNull(), F.struct(F.col(f"_to{k}").alias("to"), F.lit(name).alias("by"))) for k, (*_, name) in enumerate(maps)))
    return out.withColumn("_first", first).select(*df.columns, F.col("_first.to").alias("mapped_to"), F.col("_first.by").alias("mapped_by"))


def gather_by_key(wanted: DataFrame, df: DataFrame, key: str, position: str) -> DataFrame:
    """df's columns at the wanted (position, key) places; a key may be wanted more than once, one that df lacks gives nulls."""
    return wanted.select(position, key).join(df, key, "left")


def capped_strata_sample(df: DataFrame, key: str, group: Column, strata: Mapping[str, tuple[Column, int]], per_group: int, seed: int = 42, prefix: str = "VAL") -> DataFrame:
    """(key, stratum, place, id): so many rows of each stratum in turn, at most per_group of one group over all strata; a sampling operator.

    Rows come in the order of a hash. A row is passed over once its group is full, which is to say if its rank among the
    group's rows of the stratum is beyond what earlier strata left: so no walk over rows is needed. The sample is as
    small as the quotas. Raises if a stratum can't be filled.
    """
    spark = df.sparkSession
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    chosen: list[tuple] = []
    used: dict[str, int] = {}
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.coalesce(group.cast("string"), F.concat(F.lit("missing-"), F.col(key).cast("string"))).alias("_g"), order.alias("_o"), *(c.alias(f"_s{k}") for k, (c, _) in enumerate(strata.values())))
    for k, (name, (_, quota)) in enumerate(strata.items()):
        left = rows.where(F.col(f"_s{k}"))
        if chosen:
            left = left.join(F.broadcast(spark.createDataFrame([(c[0],) for c in chosen], f"`{key}` {kind}")), key, "left_anti")
            left = left.join(F.broadcast(spark.createDataFrame(list(used.items()), "_g string, _used int")), "_g", "left")
        else:
            left = left.withColumn("_used", F.lit(0))
        ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_o", key))).where(F.col("_r") <= per_group)
        found = ranked.where(F.col("_r") <= per_group - F.coalesce("_used", F.lit(0))).orderBy("_o", key).limit(quota).select(key, "_g").collect()
        if len(found) < quota:
            raise ValueError(f"only {len(found)} of {quota} rows for {name}")
        for r in found:
            chosen.append((r[key], name, len(chosen) + 1))
            used[r["_g"]] = used.get(r["_g"], 0) + 1
    out = spark.createDataFrame(chosen, f"`{key}` {kind}, stratum string, place long")
    return out.withColumn("id", F.format_string(f"{prefix}%03d", "place"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of seed and key; a sampling operator."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


#: Which conditions make a record ready for which use, each over flags or earlier rules.
READINESS = {
    "pce_model_usable_target": "pce_target_available",
    "pce_context_partial": "pce_target_available and (composition_available or device_available or processing_available)",
    "pce_model_ready_minimal": "pce_target_available and (composition_available or device_available)",
    "pce_model_ready_strict": "pce_target_available and composition_available and device_available and processing_available",
    "stability_model_usable_target": "stability_target_available and (stability_time_available or after_1000h_available)",
    "stability_model_ready_minimal": "stability_model_usable_target and (composition_available or device_available or stability_conditions_available)",
    "stability_model_ready_strict": "stability_model_ready_minimal and device_available and stability_conditions_available",
}


def readiness(df: DataFrame, flags: Mapping[str, Column], rules: Mapping[str, str] = READINESS) -> DataFrame:
    """df with all flags and what follows from them, rule after rule."""
    out = df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in flags.items()})
    for name, rule in rules.items():
        out = out.withColumn(name, F.expr(rule))
    return out


def weighted_route(scores: Mapping[str, tuple[Column, float]], routes: Sequence[tuple[str, float]], otherwise: str) -> tuple[Column, Column]:
    """(score, route): the sum of the points whose condition holds, and the first route whose least score it reaches."""
    score = sum((F.when(c, F.lit(float(points))).otherwise(0.0) for c, points in scores.values()), F.lit(0.0))
    route = F.lit(otherwise)
    for name, least in sorted(routes, key=lambda r: r[1]):
        route = F.when(score >= least, F.lit(name)).otherwise(route)
    return score, route


def token_coverage(title: Column, text: Column, least_length: int = 4, stop: Sequence[str] = ()) -> Column:
    """A struct (tokens, matched, coverage): which part of a title's longer words a text has."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    wanted = F.filter(F.array_distinct(words(title)), lambda w: (F.length(w) >= least_length) & ~w.isin(list(stop)) if stop else F.length(w) >= least_length)
    matched = F.size(F.array_intersect(wanted, words(text)))
    return F.struct(F.size(wanted).alias("tokens"), matched.alias("matched"), F.coalesce(F.try_divide(matched.cast("double"), F.size(wanted)), F.lit(0.0)).alias("coverage"))


def source_alignment(has_text: Column, key_in_text: Column, title: Column, domain: Column, domain_terms: Column, foreign: Column) -> Column:
    """Whether a source text is that of its record; title is a struct of token_coverage(); the first rung that holds."""
    enough = title["matched"] >= F.when(title["tokens"] <= 5, 2).otherwise(3)
    identity = key_in_text | enough & (title["coverage"] >= 0.40)
    in_domain = (domain >= 3) & (domain_terms >= 2)
    return F.when(~has_text, "fail_no_ranked_source_text").when((foreign > 0) & ~in_domain, "fail_foreign_domain").when(~in_domain, "fail_target_domain").when(identity, "pass").otherwise("review_identity_unconfirmed")


#: What a text must mention, by policy: flag and words of which one is enough.
OUTPUT_CHECKS = {
    "humean_evidence": (("missing_explicit_evidence_grounding", r"evidence|reported|observed"), ("direct_evidence_and_interpretation_not_separated", r"interpret|suggest")),
    "kantian_constraints": (("missing_constraint_or_schema_check", r"constraint|schema|required"),),
    "socratic_uncertainty": (("missing_uncertainty_or_assumption_check", r"uncertain|assumption|missing"),),
    "cartesian_decomposition": (("missing_stepwise_decomposition", r"\b(step|first|second|third|input|output|calculate|fit)\b"),),
}


def output_flags(policy: Column, text: Column, checks: Mapping[str, Sequence[tuple[str, str]]] = OUTPUT_CHECKS) -> Column:
    """The flags of what a policy wants said and a text doesn't say."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when((policy == name) & ~low.rlike(pattern), F.lit(flag)) for name, wanted in checks.items() for flag, pattern in wanted)))
