"""Values recovered from free text: candidates of several patterns are scored by the words around them and the best is kept.

Match offsets and windows around them are needed, which SQL functions don't give, so rows go through Arrow batches; each
row is read alone and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

I = re.IGNORECASE  # noqa: E741

# Patterns and context words.
EFFICIENCY = r"(?:PCE|power conversion efficienc(?:y|ies)|photo[- ]?conversion efficienc(?:y|ies))"
EXPLICIT_AFTER = rf"\b{EFFICIENCY}\s*(?:of|=|:|reached|reaches|achieved|achieves|delivered|yields|yielded|up to|exceeding|over|above|as high as|was|is)?\s*(\d{{1,2}}(?:\.\d+)?)\s*%"
EXPLICIT_BEFORE = r"\b(\d{1,2}(?:\.\d+)?)\s*%\s*(?:PCE|power conversion efficiency|photo[- ]?conversion efficiency)\b"
DEVICE = r"\b(?:champion|best|maximum|optimized|control|target|certified|record|device|cell|PSC|solar cell)[^.\n]{0,140}\b(?:efficienc(?:y|ies)|performance)[^.\n]{0,90}?(\d{1,2}(?:\.\d+)?)\s*%"
VOC = (r"\bV(?:oc|OC)\s*(?:=|:|of|was|is)?\s*(\d(?:\.\d+)?)\s*V\b", r"\bopen[- ]circuit voltage\s*(?:=|:|of|was|is)?\s*(\d(?:\.\d+)?)\s*V\b")
JSC = (r"\bJ(?:sc|SC)\s*(?:=|:|of|was|is)?\s*(\d{1,2}(?:\.\d+)?)\s*mA\s*cm\s*(?:-2|-?2|\^-2)", r"\bshort[- ]circuit current(?: density)?\s*(?:=|:|of|was|is)?\s*(\d{1,2}(?:\.\d+)?)\s*mA\s*cm\s*(?:-2|-?2|\^-2)")
FILL = (r"\bFF\s*(?:=|:|of|was|is)?\s*(0?\.\d{2,3}|\d{1,2}(?:\.\d+)?)\s*%?", r"\bfill factor\s*(?:=|:|of|was|is)?\s*(0?\.\d{2,3}|\d{1,2}(?:\.\d+)?)\s*%?")
HOURS = r"(\d{1,5}(?:[.,]\d+)?)\s*(?:h|hours|hrs)\b"
T80 = (rf"\bT\s*80\b\s*(?:=|:|of|was|is|reached|exceeded|over|above|>|~|approximately|about)?\s*{HOURS}", rf"\b{HOURS}[^.\n]{{0,80}}?\bT\s*80\b")
T95 = (rf"\bT\s*95\b\s*(?:=|:|of|was|is|reached|exceeded|over|above|>|~|approximately|about)?\s*{HOURS}", rf"\b{HOURS}[^.\n]{{0,80}}?\bT\s*95\b")
RETENTION = (
    rf"\b(?:retained|retention|maintained|remaining|retains?)\b[^.\n]{{0,120}}?(\d{{2,3}}(?:\.\d+)?)\s*%[^.\n]{{0,140}}?(?:after|for|over|during|under|at)?\s*{HOURS}",
    rf"\b(\d{{2,3}}(?:\.\d+)?)\s*%[^.\n]{{0,120}}?\b(?:retained|retention|maintained|remaining)\b[^.\n]{{0,140}}?(?:after|for|over|during|under|at)?\s*{HOURS}",
)
DEVICE_WORDS = r"\b(champion|best|optimized|certified|record|device|cell|PSC|solar cell|J-V|JV)\b"
GOOD = r"\b(PCE|power conversion|photoconversion|device|cell|solar|photovoltaic|PSC|champion|certified|Voc|Jsc|fill factor|FF|J-V|JV)\b"
BAD = r"\b(retention|retained|humidity|RH|relative humidity|degradation|quantum yield|PLQY|EQE|IPCE|transmittance|absorbance|external quantum efficiency)\b"
CITED = r"\b(references|bibliography|copyright|publisher|permission|adapted with permission|all rights reserved|reported by others|previously reported)\b"
STABILITY = r"\b(stability|stable|aging|ageing|aged|lifetime|T80|T95|retention|retained|maintained|degradation|MPP|maximum power point|ISOS|humidity|RH|thermal|illumination|encapsulat|unencapsulat)\b"
SETTING = r"\b(unencapsulated|encapsulated|ambient|air|nitrogen|RH|humidity|illumination|MPP|maximum power point|ISOS|thermal)\b"
SUBJECT = r"\b(device|cell|PSC|solar cell|PCE|efficiency|perovskite)\b"
SECOND_HAND = r"\b(review|perspective|reported by others|literature)\b"
LOSS = r"\b(loss|lost|lose|loses|degrad(?:e|es|ed|ation) by|drop(?:s|ped)? by|decrease(?:s|d)? by|decay(?:s|ed)? by)\b"
OWN_WORDS = r"\b(PCE|power conversion|device|cell|PSC|solar)\b"
#: Patterns and contexts of the audit of candidates, which is looser than recovery.
AUDIT = (
    r"\bPCE\s*(?:of|=|:|reached|reaches|achieved|achieves|up to|exceeding|over|above|as high as|was|is)?\s*(\d{1,2}(?:\.\d+)?)\s*%",
    r"\bpower conversion efficienc(?:y|ies)\s*(?:of|=|:|reached|reaches|achieved|achieves|up to|exceeding|over|above|as high as|was|is)?\s*(\d{1,2}(?:\.\d+)?)\s*%",
    r"\b(?:champion|best|maximum|certified|record|device|cell|PSC|solar cell)[^.\n]{0,120}\b(?:efficienc(?:y|ies)|PCE)[^.\n]{0,80}?(\d{1,2}(?:\.\d+)?)\s*%",
    r"\b(?:champion|best|maximum|certified|record|device|cell|PSC|solar cell)[^.\n]{0,180}?(\d{1,2}(?:\.\d+)?)\s*%\s*(?:PCE|power conversion efficiency|efficiency)\b",
    r"\b(\d{1,2}(?:\.\d+)?)\s*%\s*(?:PCE|power conversion efficiency|photoconversion efficiency)\b",
)
AUDIT_BAD = r"\b(retention|retained|humidity|RH|relative humidity|degradation|yield|quantum yield|PLQY|EQE|IPCE|transmittance|absorbance)\b"
AUDIT_GOOD = r"\b(PCE|power conversion|photoconversion|device|cell|solar|photovoltaic|PSC|champion|certified|Voc|Jsc|fill factor|FF)\b"
MOIST = r"\b(RH|relative humidity|humidity)\b"


@dataclass(frozen=True)
class Clue:
    """Adds points if its pattern is found in the window, the match or the text before it, and `unless` is not found in the match.

    case: letters count as written. side: instead of a pattern, the name of a side value that is there.
    """

    points: int
    pattern: str = ""
    where: str = "window"
    unless: str | None = None
    case: bool = False
    side: str | None = None


@dataclass(frozen=True)
class Side:
    """A number beside a match: of several patterns the first whose first match in the window lies in the range."""

    patterns: Sequence[str]
    low: float
    high: float

    def find(self, window: str) -> float | None:
        for p in self.patterns:
            m = re.search(p, window, I)
            if m and self.low <= (number := float(m[1].replace(",", ""))) <= self.high:
                return number
        return None


@dataclass(frozen=True)
class Recovery:
    """What to look for and how to weigh it; groups of a pattern are the values, compared after the score in the order of `prefer`.

    required, refuse_near and so on are patterns that must, or must not, be found in the window or near the match;
    refuse_unless pairs one of the window with one of the match that excuses it. holds: what every match has somewhere, a
    short pattern; no match is longer than `reach`, so only the text within that reach of it is searched. tells: strings in
    lower case of which every match has at least one, so a text without any of them is not searched.
    """

    patterns: Mapping[str, Sequence[str]]
    ranges: Sequence[tuple[float, float]]
    width: int
    least_score: int
    clues: Sequence[Clue] = ()
    kind_points: Mapping[str, int] = field(default_factory=dict)
    steps: Sequence[tuple[int, float, bool, int]] = ()  # (value, limit, whether at or above it, points)
    outside: tuple[float, float, int] | None = None  # points if the first value is outside
    required: str | None = None
    refuse_before: str | None = None
    refuse_near: str | None = None
    refuse_unless: tuple[str, str] | None = None
    sides: Mapping[str, Side] = field(default_factory=dict)
    holds: str | None = None
    reach: int = 600
    tells: Sequence[str] = ()
    prefer: Sequence[int] = (0,)


PERFORMANCE = Recovery(
    patterns={"explicit_pce_after": (EXPLICIT_AFTER,), "explicit_pce_before": (EXPLICIT_BEFORE,), "device_efficiency": (DEVICE,)},
    ranges=((5, 30),), width=220, least_score=9, holds="%", tells=("pce", "efficienc", "performance"), required=GOOD, outside=(8, 28, -1), kind_points={"explicit_pce_after": 3, "explicit_pce_before": 3},
    sides={"voc": Side(VOC, 0.4, 1.5), "jsc": Side(JSC, 1.0, 35.0), "ff": Side(FILL, 0.2, 90.0)},
    clues=(
        Clue(4, r"PCE|(?i:power conversion|photoconversion)", "match", case=True), Clue(3, DEVICE_WORDS), Clue(-3, CITED), Clue(-5, BAD, unless=OWN_WORDS), *(Clue(1, side=side) for side in ("voc", "jsc", "ff")),
    ),
)
_STABLE = (Clue(4, STABILITY), Clue(2, SUBJECT), Clue(2, SETTING), Clue(-4, CITED), Clue(-2, SECOND_HAND))
AUDITED = Recovery(patterns={"candidate": AUDIT}, ranges=((5, 30),), width=220, least_score=0, holds="%", tells=("pce", "efficienc"), required=AUDIT_GOOD, refuse_unless=(AUDIT_BAD, OWN_WORDS))
LIFETIME = Recovery(patterns={"t80": T80}, holds="T ?80", tells=("t80", "t 80"), ranges=((1, 100_000),), width=240, least_score=6, clues=_STABLE)
LIFETIME_95 = Recovery(patterns={"t95": T95}, holds="T ?95", tells=("t95", "t 95"), ranges=((1, 100_000),), width=240, least_score=6, clues=_STABLE)
RETAINED = Recovery(patterns={"retention": RETENTION}, holds="%", tells=("retain", "retention", "maintained", "remaining"), ranges=((1, 120), (1, 100_000)), width=240, least_score=6, clues=_STABLE, steps=((1, 100, True, 1), (1, 500, True, 1)), refuse_before=LOSS, refuse_near=MOIST, prefer=(1, 0))


def squeezed(text: str) -> str:
    """A text with one space for each run of white space, as by re.sub of \\s+, which takes three times as long."""
    body = " ".join(text.split())
    if not body:
        return " " if text else ""
    return " " * text[0].isspace() + body + " " * text[-1].isspace()


def folded(text: str) -> str:
    """A text in lower case, as long as it was, with the letters that re.IGNORECASE takes for others (ſ, ı, İ, K) replaced by them."""
    if not text.isascii():
        text = text.replace("ſ", "s").replace("ı", "i").replace("İ", "i")
    return text.lower()


def _regions(text: str, spec: Recovery) -> Iterator[tuple[int, int]]:
    """The stretches of a text within reach of what every match holds, joined where they overlap; the whole text if that isn't known."""
    if spec.holds is None:
        yield 0, len(text)
        return
    lo = hi = None
    for m in re.finditer(spec.holds, text, I):
        if hi is not None and m.start() - spec.reach <= hi:
            hi = m.end() + spec.reach
            continue
        if hi is not None:
            yield lo, min(hi, len(text))
        lo, hi = max(0, m.start() - spec.reach), m.end() + spec.reach
    if hi is not None:
        yield lo, min(hi, len(text))


def candidates(text: str, spec: Recovery) -> list[dict]:
    """All candidates with enough points, the best first."""
    text = squeezed(text)
    return candidates_in(text, folded(text), spec)


def candidates_in(text: str, low: str, spec: Recovery) -> list[dict]:
    """candidates() of a text that is squeezed(), with it folded()."""
    if spec.tells and not any(t in low for t in spec.tells):
        return []
    look = lambda p, s, flags=I: re.search(p, s, flags)
    found = []
    places_of = list(_regions(text, spec))
    for kind, patterns in spec.patterns.items():
        for m in (m for p in patterns for lo, hi in places_of for m in re.compile(p, I).finditer(text, lo, hi)):
            values = [float(g.replace(",", "")) for g in m.groups()]
            if not all(lo <= v <= hi for v, (lo, hi) in zip(values, spec.ranges)):
                continue
            near = text[max(0, m.start(1) - 20) : m.end(1) + 35]
            places = {"window": text[max(0, m.start() - spec.width) : m.end() + spec.width], "match": m[0], "before": text[max(0, m.start() - 60) : m.start()]}
            refused = spec.refuse_before and look(spec.refuse_before, places["before"]) or spec.refuse_near and look(spec.refuse_near, near)
            if spec.refuse_unless:
                bad, excuse = spec.refuse_unless
                refused = refused or look(bad, places["window"]) and not look(excuse, m[0])
            if refused or spec.required and not look(spec.required, places["window"]):
                continue
            sides = {name: side.find(places["window"]) for name, side in spec.sides.items()}
            score = spec.kind_points.get(kind, 0) + sum(points for k, limit, up, points in spec.steps if (values[k] >= limit) == up)
            if spec.outside and not spec.outside[0] <= values[0] <= spec.outside[1]:
                score += spec.outside[2]
            for clue in spec.clues:
                hit = sides[clue.side] is not None if clue.side else look(clue.pattern, places[clue.where], 0 if clue.case else I)
                if hit and not (clue.unless and look(clue.unless, m[0])):
                    score += clue.points
            if score >= spec.least_score:
                found.append({"values": values, "score": score, "kind": kind, "snippet": places["window"].strip(), "sides": {k: v for k, v in sides.items() if v is not None}})
    return sorted(found, key=lambda c: (c["score"], *(c["values"][k] for k in spec.prefer)), reverse=True)


def recover(df: DataFrame, key: str, text: str, spec: Recovery) -> DataFrame:
    """(key, values, score, kind, snippet, sides, candidates): the best candidate of each row that has one."""
    found = recover_all(df, key, text, {"it": spec})
    return found.select(key, *(F.col(f"it.{c}").alias(c) for c in ("values", "score", "kind", "snippet", "sides", "candidates"))).where("score is not null")


BEST = "struct<values:array<double>,score:long,kind:string,snippet:string,sides:map<string,double>,candidates:long>"


def recover_all(df: DataFrame, key: str, text: str, specs: Mapping[str, Recovery]) -> DataFrame:
    """(key, and a column for each of specs): the best candidate of each, null where there is none; texts are read once for all."""
    picked = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = pa.struct([("values", pa.list_(pa.float64())), ("score", pa.int64()), ("kind", pa.string()), ("snippet", pa.string()), ("sides", pa.map_(pa.string(), pa.float64())), ("candidates", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in specs}
            for value in batch.column(1):
                text = squeezed(value.as_py())
                low = folded(text)
                for name, spec in specs.items():
                    found = candidates_in(text, low, spec)
                    rows[name].append(found[0] | {"candidates": len(found), "sides": list(found[0]["sides"].items())} if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, kind) for r in rows.values())], [key, *rows])

    return picked.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{name} {BEST}" for name in specs))


def fill_missing(df: DataFrame, recovered: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """df with missing fields filled from recovered(key, fields), and `_changed`, the names of the filled ones."""
    r = recovered.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    j = df.join(r, key, "left")
    changed = F.array_compact(F.array(*(F.when(F.col(c).isNull() & F.col(f"_new_{c}").isNotNull(), F.lit(c)) for c in fields)))
    return j.withColumn("_changed", changed).withColumns({c: F.coalesce(c, f"_new_{c}") for c in fields}).drop(*(f"_new_{c}" for c in fields))
