"""Column expressions that clean names, identifiers, numbers and labels; every token set and trim is a parameter."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a cell may hold instead of a value.
MISSING = ("", "na", "n/a", "n.a.", "none", "null", "nan", "unknown", "-", "--", "—", "not available", "not reported", "nr", "n.r.", "not applicable")
TRUE_TOKENS = ("true", "yes", "y", "1", "1.0")
DOI_TRIM = " .;,()[]{}"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_present(c: Column | str, missing: Iterable[str] = MISSING) -> Column:
    """Not null and, trimmed and in lower case, none of the missing tokens; never null itself."""
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.coalesce(~text.isin(*missing), F.lit(False))


def norm_missing(c: Column | str, missing: Iterable[str] = MISSING) -> Column:
    """Null for a missing token, else the value as it stands, untrimmed."""
    return F.when(is_present(c, missing), _col(c))


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean(c: Column | str, missing: Iterable[str] = MISSING) -> Column:
    """White space and NUL runs become one space; a missing token becomes empty; never null."""
    text = F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[\x00\s]+", " "))
    return F.when(F.lower(text).isin(*missing), "").otherwise(text)


def normalize_name(c: Column | str) -> Column:
    text = F.replace(_col(c), F.lit("%"), F.lit(" percent "))
    return F.lower(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def normalize_doi(c: Column | str, trim: str = DOI_TRIM, both_prefixes: bool = False) -> Column:
    """Lower case without resolver and `doi:` prefix; both_prefixes strips one after the other."""
    text = F.lower(clean(c))
    if both_prefixes:
        text = F.regexp_replace(F.regexp_replace(text, r"^https?://(?:dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    else:
        text = F.regexp_replace(text, r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.btrim(text, F.lit(trim))


def normalize_title(c: Column | str, least: int = 24) -> Column:
    """A key of lower-case ASCII letters and digits; null if it would be shorter than `least`."""
    text = F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "<[^>]+>", " "))
    key = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    return F.when(F.length(key) >= least, key)


def url_key(c: Column | str) -> Column:
    """Host and path in lower case without scheme, common host prefixes, query and fragment."""
    text = F.regexp_replace(F.lower(_col(c)), r"^https?://(www\.|m\.|blog\.)?", "")
    return F.regexp_replace(F.regexp_replace(text, r"[?#].*$", ""), r"/+$", "")


def first_present(*columns: Column | str, missing: Iterable[str] = MISSING) -> Column:
    return F.coalesce(*(norm_missing(c, missing) for c in columns))


def to_number(c: Column | str) -> Column:
    """The first number of a text, thousands separators and per cent signs dropped; null if there is none."""
    text = F.regexp_replace(_col(c).cast("string"), "[,%]", "")
    return F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit("")).try_cast("double")


def numeric_midpoint(c: Column | str) -> Column:
    """The mean of a range `a-b`, the value before a plus-minus sign, else the first number, signs kept."""
    text = F.regexp_replace(_col(c).cast("string"), ",", "")
    text = F.regexp_replace(text, r"(\d)\s*(?:±|\+/-).*$", "$1")
    text = F.regexp_replace(text, r"(\d)\s*[-–—]\s*(\d)", "$1 to $2")
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda x: x.try_cast("double"))
    return F.when(F.size(found) >= 2, (F.get(found, F.lit(0)) + F.get(found, F.lit(1))) / 2).otherwise(F.get(found, F.lit(0)))


def any_in_range(columns: Sequence[Column | str], low: float, high: float) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(to_number(c).between(low, high), F.lit(False)) for c in columns))


def year_of(*columns: Column | str) -> Column:
    """The first year from 1900 to 2099 in the first column that has one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_col(c).cast("string"), r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int") for c in columns))


def truth(c: Column | str, tokens: Iterable[str] = TRUE_TOKENS) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(*tokens), F.lit(False))


def canonical_category(c: Column | str, name: str) -> Column:
    """Quotes stripped, bracketed lists joined, white space squeezed, separators made alike by the column's name, lower case; architectures named pin or nip."""
    text = F.regexp_replace(F.trim(_col(c).cast("string")), r"^['\"]+|['\"]+$", "")
    items = F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", ""))
    text = F.when(text.rlike(r"^\[.*\]$"), F.array_join(F.filter(items, lambda x: F.trim(x) != ""), "; ")).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    if "stack_sequence" in name.lower():
        text = F.regexp_replace(text, r"\s*[/|]\s*", " | ")
    if any(x in name.lower() for x in ("compounds", "solvents", "ions")):
        text = F.regexp_replace(text, r"\s*;\s*", "; ")
    text = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("spiro-ometad"), F.lit("spiro-meotad"))
    if name == "Cell_architecture":
        compact = F.regexp_replace(text, "[^a-z0-9]", "")
        text = F.when(compact.isin("pin", "inverted", "invertedplanar", "invertedplanarstructure"), "pin").when(compact.isin("nip", "regular", "regularplanar", "regularplanarstructure"), "nip").otherwise(text)
    return F.nullif(text, F.lit(""))


def label_by_rules(c: Column | str, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The label of the first rule of which a substring occurs."""
    text = F.lower(_col(c).cast("string"))
    out = None
    for label, parts in rules:
        hit = reduce(lambda a, b: a | b, (text.contains(p) for p in parts))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def stable_id(kind: str, *parts: Column | str, length: int = 20) -> Column:
    """kind in lower case and the first hex digits of a SHA-1 over the cleaned parts in lower case."""
    joined = F.concat_ws("\x1f", *(F.lower(clean(p)) for p in parts))
    return F.concat(F.lit(f"{kind.lower()}:"), F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, length))


def fingerprint(properties: Column | str) -> Column:
    """A SHA-1 over a map's entries as JSON with sorted keys."""
    return F.sha1(F.encode(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(properties))))), "UTF-8"))


def key_part(c: Column | str) -> Column:
    """The text of a key's part, with whole numbers written without decimals."""
    return F.regexp_replace(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))), r"^([-+]?\d+)\.0+$", "$1")


def row_key(group: Column | str, *parts: Column | str) -> Column:
    """group|part|part...; fails where all parts are empty."""
    own = [key_part(p) for p in parts]
    key = F.concat_ws("|", key_part(group), *own)
    return F.when(F.assert_true(F.concat(*own) != "", F.lit("a row without identity")).isNull(), key)


def parse_pairs(c: Column | str, between: str = ";") -> Column:
    """`a=1; b=2` as a map; parts without an equals sign are dropped, and of a repeated name the last value counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), between), lambda x: F.trim(x)), lambda x: x.contains("="))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"])))


def list_cell(c: Column | str, between: str = r"[;|\n]") -> Column:
    """The distinct, trimmed, non-empty items of a delimited cell, first seen first."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), between), lambda x: F.trim(x)), lambda x: x != ""))


def aligned_fractions(names: Column | str, weights: Column | str, between: str = ";") -> Column:
    """Two lists of one length as a map of fractions that add up to one; null unless all weights are finite, none negative and their sum positive."""
    keys = F.transform(F.split(_col(names), between), lambda x: F.trim(x))
    numbers = F.transform(F.split(_col(weights), between), lambda x: F.trim(x).try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    ok = (F.size(keys) == F.size(numbers)) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) & (total > 0) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(ok, F.map_from_arrays(keys, F.transform(numbers, lambda x: F.try_divide(x, total))))
