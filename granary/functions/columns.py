"""Which columns of a table may feed a model, by their names; plain functions of names, so what they choose prunes the scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts and beginnings of names.
ADMINISTRATIVE = ("ref_", "doi", "journal", "publication_date", "lead_author", "original_filename", "name_of_person_entering", "data_entered_by", "free_text_comment", "license", "url", "webpage", "raw_data", "filename", "comment", "lit_agent", "source_", "reasoning", "recovery", "evidence", "confidence_status", "paper_slug", "full_text", "json_repair")
ADMINISTRATIVE_PREFIXES = ("_", "ADD_DESC_")
PERFORMANCE_PREFIXES = ("JV_", "EQE_", "Stabilised_performance")
STABILITY_PREFIXES = ("Stability_", "Outdoor_")
PROXIES = {
    "pce": ("certified", "champion", "stabilized", "stabilised", "mppt", "reverse_scan", "forward_scan"),
    "stability_design": ("certified", "champion", "mppt", "reverse_scan", "forward_scan", "pce_model_oof_predicted_pce"),
}
TEST_CONTEXT = ("stability", "aging", "ageing", "test", "exposure", "outdoor", "lifetime")


def plain_name(name: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", name.replace("%", " percent ")).strip("_").lower()


def leakage_reason(name: str, target: str, purpose: str) -> str | None:
    """Why a column may not feed a model of that purpose: target, administrative, outcome or proxy; None if it may."""
    if name == target:
        return "target"
    low = plain_name(name)
    if name.startswith(ADMINISTRATIVE_PREFIXES) or any(part in low for part in ADMINISTRATIVE):
        return "administrative"
    if name.startswith(PERFORMANCE_PREFIXES + STABILITY_PREFIXES):
        return "outcome"
    return "proxy" if any(part in low for part in PROXIES[purpose]) else None


def feature_columns(columns: Sequence[str], target: str, purpose: str, exclude: Sequence[str] = ()) -> list[str]:
    """The columns that don't give the target away, in their order."""
    return [c for c in columns if c not in exclude and leakage_reason(c, target, purpose) is None]


def best_column(df: DataFrame, exact: Sequence[str], hints: Sequence[str], context: Sequence[str] = TEST_CONTEXT) -> str | None:
    """The first of the exact names that the table has, else the column with the most hints and, counting three times, context words in its name.

    A name without a context word or a hint is never taken; of equal scores the fullest column, then the last by name.
    Values are counted in one pass, for tied columns only.
    """
    by_name = {plain_name(c): c for c in df.columns}
    for name in exact:
        if plain_name(name) in by_name:
            return by_name[plain_name(name)]
    scores: Mapping[str, int] = {}
    for low, c in by_name.items():
        n, m = sum(x in low for x in context), sum(plain_name(h) in low for h in hints)
        if n and m:
            scores = {**scores, c: m + 3 * n}
    best = [c for c, s in scores.items() if s == max(scores.values())]
    if len(best) < 2:
        return best[0] if best else None
    full = df.agg(*(F.count(f"`{c}`").alias(c) for c in best)).first()
    return max(best, key=lambda c: (full[c], c))
