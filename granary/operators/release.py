"""Checks before results are published: files without secrets or personal paths, test samples that training never saw, reviewers that agree on numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import normalize_doi, truth

#: A relative path may have so many characters.
MOST_PATH = 180
# What must not stand in a published text, by the name of the issue.
UNWANTED = {
    "personal absolute path": r"(?i)(?:[a-z]:[\\/]+Users[\\/]+[^<\\/\s\"']+|/(?:Users|home)/[^<\s/\"']+)",
    "unexpected control character": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "credential pattern": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{25,}|AIza[0-9A-Za-z_-]{35}",
}
# Fixed values: (absolute, relative) tolerance by field; the larger of the two counts.
TOLERANCES = {
    "Cell_area_measured": (0.01, 0.05), "JV_default_PCE": (0.10, 0.01), "JV_default_Voc": (0.01, 0.01), "JV_default_Jsc": (0.20, 0.01), "JV_default_FF": (0.01, 0.02),
    "Perovskite_deposition_thermal_annealing_temperature": (2.0, 0.02), "Perovskite_deposition_thermal_annealing_time": (1.0, 0.05), "Stability_time_total_exposure": (1.0, 0.02), "Stability_temperature_range": (2.0, 0.02),
    "Stability_relative_humidity_average_value": (2.0, 0.05), "Stability_light_intensity": (0.05, 0.05), "Stability_PCE_initial_value": (0.10, 0.01), "Stability_PCE_end_of_experiment": (0.10, 0.02),
    "Stability_PCE_T80": (5.0, 0.05), "Stability_PCE_T95": (5.0, 0.05),
}


def hygiene_issues(files: DataFrame, path: str, text: str, unwanted: Mapping[str, str] = UNWANTED, most_path: int = MOST_PATH) -> DataFrame:
    """(path, issue): every issue of every file, of its name or its whole text; doubled backslashes count as single ones. Null texts have none."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = body
    for _ in range(3):
        plain = F.replace(plain, F.lit("\\\\"), F.lit("\\"))
    long = F.when(F.length(path) > most_path, F.concat(F.lit("relative path length "), F.length(path).cast("string"), F.lit(f" exceeds limit {most_path}")))
    found = F.array_compact(F.array(long, *(F.when((plain if "path" in name else body).rlike(p), F.lit(name)) for name, p in unwanted.items())))
    return files.select(path, F.explode(found).alias("issue"))


def sample_key(c: Column) -> Column:
    """A sample's key with its publication in one spelling; what follows the first bar stays as it is."""
    return F.concat(normalize_doi(F.regexp_extract(c, r"^([^|]*)", 1), both_prefixes=True), F.regexp_extract(c, r"(?s)^[^|]*(.*)$", 1))


def identity_errors(predictions: DataFrame, membership: DataFrame) -> DataFrame:
    """(error, keys): what is wrong between predictions(raw_frozen_row_key, canonical_row_key) of a test set and membership(raw_row_key, canonical_row_key, in_training, is_frozen_test_sample), and of how many keys.

    Test keys that repeat, or that are in training, or that membership doesn't mark as test samples, or that it marks but
    nobody predicted; membership keys that repeat; and keys of either that aren't sample_key() of their raw ones. Each is
    counted from one row for each key, so repeated keys are no hot ones; no row means that all is well.
    """
    key = "canonical_row_key"
    tests = predictions.groupBy(key).agg(F.count("*").alias("_tests"), F.count_if(~sample_key(F.col("raw_frozen_row_key")).eqNullSafe(F.col(key))).alias("_odd_tests"))
    members = membership.groupBy(key).agg(
        F.count("*").alias("_members"), F.count_if(~sample_key(F.col("raw_row_key")).eqNullSafe(F.col(key))).alias("_odd_members"), F.max(truth("in_training")).alias("_trained"), F.max(truth("is_frozen_test_sample")).alias("_marked"),
    )
    both = tests.join(members, tests[key].eqNullSafe(members[key]), "full_outer")
    test, no = F.col("_tests").isNotNull(), F.lit(False)
    rules = {
        "canonical test sample identities collide": F.col("_tests") > 1,
        "canonicalization changed a sample suffix or publication contract": F.col("_odd_tests") > 0,
        "training identity crosswalk does not follow the sample-key contract": F.col("_odd_members") > 0,
        "eligible canonical sample identities collide": F.col("_members") > 1,
        "the same canonical sample appears in training and test": test & F.col("_trained"),
        "training audit does not identify every frozen test sample": test != F.coalesce(F.col("_marked"), no),
    }
    counts = both.agg(*(F.count_if(F.coalesce(c, no)).alias(f"_{k}") for k, c in enumerate(rules.values())))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("error"), F.col(f"_{k}").alias("keys")) for k, name in enumerate(rules))))).where("keys > 0")


def publication_fold_errors(rows: DataFrame, label: str, identity: str, fold: str) -> DataFrame:
    """(error, publications): identities that are missing, that aren't the normalised label, or that lie in several folds; no row means none."""
    known = F.coalesce(F.col(identity), F.lit("")) != ""
    by = rows.withColumn("_known", known).groupBy(identity, "_known").agg(F.count_if(~normalize_doi(F.col(label), both_prefixes=True).eqNullSafe(F.col(identity))).alias("_odd"), (F.min(fold) != F.max(fold)).alias("_split"), F.count("*").alias("_n"))
    rules = {
        "stability publication identity is missing": ~F.col("_known"),
        "stability canonical publication does not match its retained source label": F.col("_known") & (F.col("_odd") > 0),
        "a canonical publication crosses historical test folds": F.col("_known") & F.col("_split"),
    }
    counts = by.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, c in enumerate(rules.values())))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("error"), F.col(f"_{k}").alias("publications")) for k, name in enumerate(rules))))).where("publications > 0")


def within_tolerance(field: Column, value: Column, gold: Column, tolerances: Mapping[str, tuple[float, float]] = TOLERANCES) -> Column:
    """Whether two numbers agree as closely as the field asks, null for other fields or without a number."""
    table = F.create_map(*(x for f, (a, r) in tolerances.items() for x in (F.lit(f), F.struct(F.lit(float(a)).alias("a"), F.lit(float(r)).alias("r")))))
    limit = F.try_element_at(table, field)
    return F.abs(value.cast("double") - gold.cast("double")) <= F.greatest(limit["a"], limit["r"] * F.abs(gold.cast("double")))


def numeric_agreement(core: DataFrame, field: str, present: str, decision: str, fields: Sequence[str] = tuple(TOLERANCES)) -> DataFrame:
    """(field, n, agreement) of the numeric fields that adjudicators found in the source and judged: the share judged yes; a field '' is all of them."""
    label = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    judged = core.where(F.col(field).isin(*fields) & (label(present) == "yes") & label(decision).isin("yes", "no", "partial"))
    by = judged.groupBy(F.col(field).alias("field")).agg(F.count("*").alias("n"), F.count_if(label(decision) == "yes").alias("_yes"))
    whole = by.agg(F.lit("").alias("field"), F.sum("n").alias("n"), F.sum("_yes").alias("_yes")).where("n is not null")
    return by.union(whole).select("field", "n", (F.col("_yes") / F.col("n")).alias("agreement"))


def review_category(field: str, c: Column) -> Column:
    """A category as reviewers compare it: lower case and single spaces; architectures and test protocols by their names; __missing__ for none."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))
    compact = F.regexp_replace(text, "[^a-z0-9]+", "")
    plain = F.when(text == "", "__missing__").otherwise(text)
    if field == "Cell_architecture":
        known = F.when(compact.contains("mesoporous"), "mesoporous").when(compact.contains("inverted") | (compact == "pin"), "p-i-n")
        return known.when(compact.contains("conventional") | compact.contains("regular") | (compact == "nip"), "n-i-p").otherwise(plain)
    if field == "Stability_protocol":
        p = r"isos\s*[-_ ]?\s*([a-z])\s*[-_ ]?\s*(\d+)"
        return F.when(text.rlike(p), F.concat(F.lit("ISOS-"), F.upper(F.regexp_extract(text, p, 1)), F.lit("-"), F.regexp_extract(text, p, 2))).otherwise(plain)
    return plain


def shapes_document(required: Mapping[str, Sequence[str]], values: Mapping[str, Mapping[str, str]] | None = None, prefixes: Mapping[str, str] | None = None, name: str = "la") -> str:
    """SHACL shapes in Turtle: of each class the properties that must be there, and those that must have one value."""
    lines = [f"@prefix {p}: <{uri}> ." for p, uri in {"sh": "http://www.w3.org/ns/shacl#", **(prefixes or {})}.items()]
    path = lambda p: p if ":" in p else f"{name}:{p}"
    for kind in dict.fromkeys([*required, *(values or {})]):
        rules = [f"sh:property [ sh:path {path(p)} ; sh:minCount 1 ]" for p in required.get(kind, ())]
        rules += [f'sh:property [ sh:path {path(p)} ; sh:hasValue "{v}" ]' for p, v in (values or {}).get(kind, {}).items()]
        lines += ["", " ;\n  ".join([f"{name}:{kind}Shape a sh:NodeShape", f"sh:targetClass {name}:{kind}", *rules]) + " ."]
    return "\n".join(lines) + "\n"
