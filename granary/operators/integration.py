"""Records of one device, paper or sample made one: collapse by evidence, merges without conflict, backfill, annotation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from granary.functions.normalize import aligned_fractions, clean

# Words by which a sentence says that it speaks of the untreated or of the treated device.
CONTROL_WORDS = r"(?i)\b(?:control|reference|pristine|untreated|unmodified|bare)\b"
TREATED_WORDS = r"(?i)\b(?:champion|optimi[sz]ed|passivat\w*|treated|modified|target)\b"
#: What an id says of its own value.
STATED_VALUE = r"(?:_(?:control|target|champion))?_pce_\d+p\d+$"
#: Statuses that count as accepted.
ACCEPTED = ("accepted", "weak_accepted", "sparse_accepted")


def role(text: Column) -> Column:
    """control, treated, or null if a text names neither or both."""
    a, b = text.rlike(CONTROL_WORDS), text.rlike(TREATED_WORDS)
    return F.when(a & ~b, F.lit("control")).when(b & ~a, F.lit("treated"))


def stated_in(value: Column, text: Column) -> Column:
    """Whether one of the numbers of a text is the value, to four places; false without a text or a value."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![\d.])-?\d+(?:\.\d+)?"), F.lit(0))
    return F.coalesce(F.exists(numbers, lambda x: F.round(x.cast("double"), 4) == F.round(value.cast("double"), 4)), F.lit(False))


def collapse_devices(records: DataFrame, identity: Sequence[str], key: str, target: str, order: str, evidence: Mapping[str, str] | None = None, warning: str = "warning") -> DataFrame:
    """One row for each device: rows that agree in all `identity` columns, nulls equal, and have a target value.

    Each other column takes the present value that its evidence speaks for most: evidence that speaks of the same kind
    of device (control or treated) as the target's own counts most, then evidence that has the value, then the first by
    `order`; columns without evidence in `evidence` (column -> column of its sentence) take the first present value, and
    a sentence stays with its value. A device of several rows is named after its value: what the id said of a value
    gives way to _target_pce_21p61, or _control_pce_21p61 if the target's evidence speaks of a control; `warning` says
    how many rows became one. Rows without a target stay as they are. One aggregate over the identity: rows combine
    before the shuffle, and a device with very many rows is no hot key.
    """
    evidence = dict(evidence or {})
    rest = [c for c in records.columns if c not in identity and c != warning]
    sentence_of = {s: c for c, s in evidence.items()}
    known = role(F.col(evidence[target])) if target in evidence else F.lit(None).cast("string")

    def merit(c: str) -> Column:
        spoken = F.col(evidence[c])
        same = F.when(role(spoken) == known, 2).when(role(spoken).isNotNull() & known.isNotNull(), 0).otherwise(1)
        number = stated_in(F.col(c), spoken) if dict(records.dtypes)[c] not in ("string", "boolean") else spoken.isNotNull()
        return F.struct((-same).alias("unlike"), (~number).alias("unstated"), F.col(order).alias("order"))

    has = records.where(F.col(target).isNotNull()).withColumns({"_known": known} | {f"_rank{k}": merit(c) for k, c in enumerate(evidence)})
    rank_of = {c: F.col(f"_rank{k}") for k, c in enumerate(evidence)}

    def best(c: str) -> Column:
        of = sentence_of.get(c, c)
        return F.min_by(F.col(c), F.when(F.col(of).isNotNull() & F.col(c).isNotNull(), rank_of.get(of, F.col(order))))

    grouped = has.groupBy(*identity).agg(*(best(c).alias(f"_best{k}") for k, c in enumerate(rest)), F.count("*").alias("_n"), F.max(F.when(F.col("_known") == "treated", 1)).alias("_treated"), F.max(F.when(F.col("_known") == "control", 1)).alias("_control"))
    grouped = grouped.withColumnsRenamed({f"_best{k}": c for k, c in enumerate(rest)})
    name = F.when(F.col("_control").isNotNull() & F.col("_treated").isNull(), F.lit("_control")).otherwise(F.lit("_target"))
    value = F.regexp_replace(F.format_string("%.2f", F.col(target).cast("double")), r"\.", "p")
    several = F.col("_n") > 1
    out = grouped.withColumn(key, F.when(several, F.concat(F.regexp_replace(F.col(key), STATED_VALUE, ""), name, F.lit("_pce_"), value)).otherwise(F.col(key)))
    out = out.withColumn(warning, F.when(several, F.concat(F.lit("Collapsed "), F.col("_n").cast("string"), F.lit(" duplicate rows of one device"))))
    names = [*(c for c in records.columns if c != warning), warning]
    alone = records.where(F.col(target).isNull()).withColumn(warning, F.lit(None).cast("string"))
    return out.select(names).unionByName(alone.select(names))


def merge_same_device(records: DataFrame, keys: Sequence[str], decisive: Sequence[str], order: str, preferred: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of one device id become one, unless they contradict each other in a decisive column (target or test condition).

    If some decisive column has two different values in an id, its rows stay apart by all decisive columns and only rows
    equal in these merge. Other columns that differ take the value whose sentence is there (`preferred`: column ->
    column of its sentence), then the first by `order`; no row's value is lost where nothing else is known. Null ids are no
    device: their rows stay.
    """
    preferred = dict(preferred or {})
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = records.where(known)
    clash = rows.groupBy(*keys).agg(F.lit(False).alias("_x"), *(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"_clash{k}") for k, c in enumerate(decisive)))
    any_clash = F.lit(False)
    for k in range(len(decisive)):
        any_clash = any_clash | F.col(f"_clash{k}")
    marked = rows.join(clash.select(*keys, any_clash.alias("_apart")), list(keys))
    apart = [F.when(F.col("_apart"), F.col(c)).alias(f"_d{k}") for k, c in enumerate(decisive)]
    rest = [c for c in records.columns if c not in keys]

    def best(c: str) -> Column:
        spoken = F.col(preferred[c]).isNull() if c in preferred else F.lit(False)
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(spoken.alias("s"), F.col(order).alias("o"))))

    merged = marked.groupBy(*keys, *apart).agg(*(best(c).alias(f"_best{k}") for k, c in enumerate(rest))).withColumnsRenamed({f"_best{k}": c for k, c in enumerate(rest)})
    return merged.select(records.columns).unionByName(records.where(~known))


def backfill_empty(existing: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(existing with its empty fields filled, report): a field that has a value is never changed.

    Each field takes the first present value by `order` of the incoming rows of its key. report: (key, column, value) of
    every field filled. Empty: null, blank or a missing token. Rows without key stay; keys that only come in are left out.
    """
    filled = lambda c: F.when(clean(F.col(c)) != "", F.col(c))
    given = incoming.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*(F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(f"_in_{c}") for c in columns))
    joined = existing.join(given, F.col(key) == F.col("_key"), "left")
    out = joined.select(*(F.coalesce(filled(c), F.col(f"_in_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns))
    gains = F.array(*(F.struct(F.lit(c).alias("column"), F.when(filled(c).isNull(), F.col(f"_in_{c}")).cast("string").alias("value")) for c in columns))
    report = joined.where("_key is not null").select(key, F.inline(F.filter(gains, lambda x: x["value"].isNotNull())))
    return out, report


def integration_outcomes(audit: DataFrame | GroupedData, status: str = "status") -> DataFrame:
    """Counts, one row (or one for each group of a grouped table): accepted_total, accepted, weak_accepted, sparse_accepted, rejected, audited."""
    return audit.agg(F.count_if(F.col(status).isin(*ACCEPTED)).alias("accepted_total"), *(F.count_if(F.col(status) == s).alias(s) for s in (*ACCEPTED, "rejected")), F.count(status).alias("audited"))


def annotation_tables(sample: DataFrame, record: str, doi: str, sample_id: str, core: Mapping[str, Sequence[str]], evidence: DataFrame, aside: Sequence[str] = (), prefixes: Sequence[str] = ("_",), excerpt: int = 32_000) -> DataFrame:
    """A row for each field that an annotator is to judge: record, doi, sample_id, kind, family, field, value, evidence.

    kind core: every core field (family -> fields) of every record, with or without a value, and in the table or not;
    kind populated: every other column with a value, but for those in `aside` and those that begin with one of prefixes.
    evidence(doi, sample_id, field, evidence, seq): the first excerpt by seq of the field's, at most `excerpt` characters,
    DOIs compared without case. Fields are laid out in the row, not joined, and evidence is looked up in one join.
    """
    names = {f: family for family, fields in core.items() for f in fields}
    text = lambda c: clean(F.col(c)) if c in sample.columns else F.lit("")
    own = {record, doi, sample_id, *aside}
    others = [c for c in sample.columns if c not in own and c not in names and not c.startswith(tuple(prefixes))]
    item = lambda kind, family, f: F.struct(F.lit(kind).alias("kind"), F.lit(family).alias("family"), F.lit(f).alias("field"), text(f).alias("value"))
    laid = F.concat(F.array(*(item("core", family, f) for f, family in names.items())), F.filter(F.array(*(item("populated", "", c) for c in others)), lambda x: x["value"] != "")) if others else F.array(*(item("core", family, f) for f, family in names.items()))
    rows = sample.select(record, F.lower(text(doi)).alias("doi"), text(sample_id).alias("sample_id"), F.inline(laid))
    said = evidence.select(F.lower(clean("doi")).alias("_doi"), clean("sample_id").alias("_sample"), clean("field").alias("_field"), F.substring(clean("evidence"), 1, excerpt).alias("_text"), "seq").where("_doi <> '' and _field <> '' and _text <> ''")
    first = said.groupBy("_doi", "_sample", "_field").agg(F.min_by("_text", "seq").alias("_text"))
    found = rows.join(first, (F.col("doi") == F.col("_doi")) & (F.col("sample_id") == F.col("_sample")) & (F.col("field") == F.col("_field")), "left")
    return found.select(record, "doi", "sample_id", "kind", "family", "field", "value", F.coalesce("_text", F.lit("")).alias("evidence"))


def wide_fractions(df: DataFrame, names: str, weights: str, prefix: str, most: int = 2000) -> DataFrame:
    """df with <prefix>_<name>_fraction for every name that occurs, and <prefix>_valid: two aligned lists as one column for each name.

    A name that a row doesn't have is 0 there; where the lists can't be read all fractions are null and valid is 0. Names
    are found in one pass that sends one row for each task and name; more than `most` are an error. Columns that exist
    are not overwritten: the new ones follow in the order of names.
    """
    parsed = df.withColumn("_map", aligned_fractions(names, weights))
    found = [r[0] for r in parsed.select(F.explode(F.map_keys("_map")).alias("n")).distinct().orderBy("n").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names")
    taken = {c.lower() for c in df.columns}
    made = {f"{prefix}_{n}_fraction": F.when(F.col("_map").isNotNull(), F.coalesce(F.try_element_at("_map", F.lit(n)), F.lit(0.0))) for n in found}
    made[f"{prefix}_valid"] = F.col("_map").isNotNull().cast("double")
    return parsed.select(*df.columns, *(c.alias(n) for n, c in made.items() if n.lower() not in taken))


def choice_state(value: Column, choices: Mapping[str, Sequence[str]], other: str = "other", missing: str = "not_reported") -> Column:
    """The state whose words (whole, without case) a cleaned value has, tried in order; other for any other value, missing for none."""
    text = clean(value)
    out = F.when(text == "", missing)
    for state, words in choices.items():
        out = out.when(text.rlike(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(words) + r")(?![A-Za-z0-9])"), state)
    return out.otherwise(other)


def context_label(columns: Sequence[str], between: str = " | ", missing: str = "unspecified") -> Column:
    """The cleaned values of several columns as one label, `missing` where there is none."""
    return F.concat_ws(between, *(F.coalesce(F.nullif(clean(F.col(c)), F.lit("")), F.lit(missing)) for c in columns))


def display_token(c: Column) -> Column:
    """A field or category name for people: prefixes of schemas off, underscores as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(c), r"^(?:[A-Z]{2,4}_)", ""), r"_+", " "))

