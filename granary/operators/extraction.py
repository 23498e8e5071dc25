"""Conditions, terms, sentences and numbers near an anchor, from free text.

Texts go through Arrow batches, for match offsets and because a text's words, taken once, tell which patterns can match
at all: Java's regular expressions, one scan for each pattern and case folded at every place, took most of the time. Each
row is read alone and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.recovery import AUDITED, LIFETIME, LIFETIME_95, PERFORMANCE, RETAINED, Recovery, candidates, candidates_in, folded, squeezed

# Patterns of test conditions, terms and anchors.
TEMPERATURE = (r"\b(?:at|under|temperature|thermal|heated|aging|ageing)[^.\n]{0,80}?(\d{1,3}(?:\.\d+)?)\s*(?:°\s*C|deg(?:ree)?s?\s*C|C)\b",)
HUMIDITY = (r"\b(\d{1,3}(?:\.\d+)?)\s*%\s*(?:RH|relative humidity|humidity)\b", r"\b(?:RH|relative humidity|humidity)\s*(?:of|=|:|at)?\s*(\d{1,3}(?:\.\d+)?)\s*%")
LIGHT = (r"\b(1(?:\.0)?|0?\.\d+|\d+(?:\.\d+)?)\s*(?:sun|suns)\b", r"\b(\d{2,4}(?:\.\d+)?)\s*mW\s*cm\s*(?:-2|-?2|\^-2)\b")
ATMOSPHERES = ("ambient", "air", "nitrogen", "N2", "argon", "glovebox")
SOLVENTS = ("DMF", "DMSO", "NMP", "GBL", "CB", "chlorobenzene", "toluene", "IPA", "isopropanol", "ethanol", "methanol", "acetonitrile", "ethyl acetate", "diethyl ether", "anisole")
ADDITIVES = ("MACl", "FACl", "NH4Cl", "Pb(SCN)2", "KSCN", "KI", "KCl", "RbI", "CsI", "PEAI", "BAI", "FPEAI", "OAI", "PEACl", "EDAI2", "BDAI2", "GABr", "MAAc", "FABr", "MABr", "PbI2", "PbBr2")
METHODS = {
    "spin coating": r"\bspin[- ]coat(?:ing|ed)?\b",
    "blade coating": r"\bblade[- ]coat(?:ing|ed)?\b",
    "slot-die coating": r"\bslot[- ]die\b",
    "thermal evaporation": r"\bthermal(?:ly)? evaporat(?:ion|ed)\b",
    "spray coating": r"\bspray[- ]coat(?:ing|ed)?\b",
    "doctor blading": r"\bdoctor blad(?:ing|ed)\b",
    "chemical bath deposition": r"\bchemical bath deposition\b|\bCBD\b",
    "atomic layer deposition": r"\batomic layer deposition\b|\bALD\b",
    "sputtering": r"\bsputter(?:ing|ed)?\b",
}
SOLVENT_SENTENCE = r"\b(?:DMF|DMSO|NMP|GBL|chlorobenzene|toluene|antisolvent|solvent)\b"
SOLVENT_RATIO = r"\b(?:DMF|DMSO|NMP|GBL|solvent[s]?)\b[^.\n]{0,100}?\b(\d+(?:\.\d+)?\s*:\s*\d+(?:\.\d+)?(?:\s*:\s*\d+(?:\.\d+)?)?)\b"
ADDITIVE_SENTENCE = r"\b(?:additive|MACl|FACl|PEAI|BAI|passivat|dop)\b"
ANNEAL = r"\banneal(?:ing|ed)?\b"
AREA = r"\b(?:active|aperture|device|cell|masked)\s+area\b"
ELECTRON_LAYER = r"\b(?:ETL|electron transport layer|SnO2|TiO2|C60|PCBM)\b"
HOLE_LAYER = r"\b(?:HTL|hole transport layer|Spiro|PTAA|PEDOT:PSS|NiOx)\b"
CONTACT = r"\b(?:Au|Ag|Al|Cu|back contact|electrode)\b"
NANOMETRES = r"(\d{1,4}(?:\.\d+)?)\s*nm\b"
FORMULAS = (
    r"\b(?:FAPbI3|MAPbI3|CsPbI3|CsPbBr3|MASnI3|FASnI3|CH3NH3PbI3|CH3NH3SnI3)\b",
    r"\b(?:CH3NH3|MA|FA|Cs|Rb|K)(?:Pb|Sn|Ge)(?:I|Br|Cl)3\b",
    r"\b(?:(?:CH3NH3|MA|FA|Cs|Rb|K)(?:\d(?:\.\d+)?)?){1,5}(?:Pb|Sn|Ge)(?:I|Br|Cl)(?:\d(?:\.\d+)?)?(?:(?:I|Br|Cl)(?:\d(?:\.\d+)?)?){0,2}\b",
)


def _of(terms: Sequence[str]) -> dict[str, tuple[frozenset[str], re.Pattern | None]]:
    """By term: its words, and how to look for it where its words alone don't tell that it is there."""
    return {t: (frozenset(w := WORD.findall(t.lower())), None if w == [t.lower()] else re.compile(rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])", re.I)) for t in terms}


def words_of(low: str, wanted: frozenset[bytes]) -> set[str]:
    """The wanted words, runs of letters and digits of ASCII, of a folded() text."""
    return {w.decode() for w in wanted.intersection(low.encode().translate(APART).split())}


def first_number(text: str, low: str, patterns: Sequence[str], least: float, most: float, holds: Sequence[str] = ()) -> float | None:
    """The number in the first match of the first pattern whose first match lies in the range; later matches aren't tried. holds: strings of which every match has one."""
    if holds and not any(h in low for h in holds):
        return None
    for p in patterns:
        m = re.search(p, text, re.I)
        if m and least <= (number := float(m[1])) <= most:
            return number
    return None


def terms_found(text: str, words: set[str], terms: Sequence[str], between: str = "; ") -> str | None:
    """The terms that stand in a text between other than letters and digits, whatever their case, in the order given; None if none does. words: words_of() the text."""
    return between.join(t for t in terms if TERMS[t][0] <= words and (TERMS[t][1] is None or TERMS[t][1].search(text))) or None


def sentence_with(text: Column, pattern: str, most: int = 1000) -> Column:
    """The sentence around the first match: from the full stop before it to the next full stop or line end; empty if there is none."""
    # cut first, so that no match is tried from every place of a long text
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: s.rlike(f"(?i)(?:{pattern})"))
    found = F.regexp_extract(F.coalesce(F.get(sentences, F.lit(0)), F.lit("")), rf"(?is)^(.*?(?:{pattern})[^\n]*)", 1)
    return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, most)


def sentence_in(text: str, pattern: str) -> str:
    """sentence_with() of one text, whole."""
    for m in re.finditer(pattern, text, re.I):
        ends = [e for e in (text.find(".", m.end()), text.find("\n", m.end())) if e != -1]
        if found := " ".join(text[text.rfind(".", 0, m.start()) + 1 : min(ends, default=len(text))].split()):
            return found
    return ""


def conditions_in(text: str, low: str, words: set[str]) -> dict[str, float | str | None]:
    """stability_conditions() of a text that is squeezed(), with it folded() and words_of() it."""
    light = first_number(text, low, LIGHT, 0.01, 1000, ("sun", "mw"))
    return {
        "temperature_c": first_number(text, low, TEMPERATURE, 0, 120),
        "rh_percent": first_number(text, low, HUMIDITY, 0, 100, ("rh", "humidity")),
        "light": light / 100 if light is not None and light > 10 else light,
        "atmosphere": terms_found(text, words, ATMOSPHERES),
        "encapsulation": "False" if "unencapsulated" in words and re.search(r"\bunencapsulated\b", text, re.I) else "True" if "encapsulated" in words and re.search(r"\bencapsulated\b", text, re.I) else None,
    }


def formula_in(text: str, low: str) -> str | None:
    """formula() of one text, with it folded()."""
    if not any(m + h in low for m in ("pb", "sn", "ge") for h in ("i", "br", "cl")):
        return None
    for p in FORMULAS:
        m = re.search(p, text, re.I)
        x = m[0].strip(" /,;:()[]{}") if m else ""
        if any(k in x for k in ("Pb", "Sn", "Ge")) and any(k in x for k in ("I", "Br", "Cl")):
            return x
    return None


def solvents_in(text: str, words: set[str]) -> dict[str, str | None]:
    """solvents_and_ratio() of one text, with words_of() it."""
    sentence = sentence_in(text, SOLVENT_SENTENCE) if SOLVENT_WORDS & words else ""
    where = sentence or text
    m = re.search(SOLVENT_RATIO, where, re.I) if SOLVENT_WORDS & words else None
    return {"solvents": terms_found(where, words_of(folded(sentence), WANTED) if sentence else words, SOLVENTS), "ratio": m[1].replace(" ", "") if m else None, "snippet": sentence}


def _read_by(find: Callable[[str], Mapping[str, object]], kinds: Mapping[str, pa.DataType], text: Column) -> dict[str, Column]:
    """Columns of what find(text) gives; null texts are read as empty ones."""
    kind = pa.struct(list(kinds.items()))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([find(t.as_py() or "") for t in texts], kind)

    read = F.arrow_udf(run, "struct<" + ", ".join(f"{name}:{'double' if k == pa.float64() else 'string'}" for name, k in kinds.items()) + ">")(text.cast("string"))
    return {name: read[name] for name in kinds}


def stability_conditions(text: Column) -> dict[str, Column]:
    """temperature_c, rh_percent, light (in suns), atmosphere and encapsulation that a text names, each null if it doesn't."""

    def find(value: str):
        t = squeezed(value)
        low = folded(t)
        return conditions_in(t, low, words_of(low, WANTED))

    return _read_by(find, {"temperature_c": pa.float64(), "rh_percent": pa.float64(), "light": pa.float64(), "atmosphere": pa.string(), "encapsulation": pa.string()}, text)


def formula(text: Column) -> Column:
    """The first chemical formula by the first pattern that finds one with a metal and a halide."""
    return _read_by(lambda value: {"formula": formula_in(value, folded(value))}, {"formula": pa.string()}, text)["formula"]


def solvents_and_ratio(text: Column) -> dict[str, Column]:
    """Solvents and their mixing ratio, from the sentence that names one, or from the whole text if none does."""
    return _read_by(lambda value: solvents_in(value, words_of(folded(value), WANTED)), {"solvents": pa.string(), "ratio": pa.string(), "snippet": pa.string()}, text)


@dataclass(frozen=True)
class Near:
    """A value in the window around an anchor: a number in a range (pattern with one group), or all the named patterns that it holds.

    words: words of which every anchor has one. holds: strings in lower case of which every value has one. A text without
    them is not searched.
    """

    anchor: str
    pattern: str | Mapping[str, str]
    low: float = float("-inf")
    high: float = float("inf")
    before: int = 180
    after: int = 240
    words: frozenset[str] = frozenset()
    holds: Sequence[str] = ()

    def may_find(self, low: str, words: set[str]) -> bool:
        """Whether a text can have a value, with it folded() and words_of() it."""
        return (not self.words or not self.words.isdisjoint(words)) and (not self.holds or any(h in low for h in self.holds))

    def find(self, text: str) -> tuple[str, str] | None:
        for m in re.finditer(self.anchor, text, re.I):
            window = text[max(0, m.start() - self.before) : m.end() + self.after]
            if isinstance(self.pattern, str):
                hit = re.search(self.pattern, window, re.I)
                number = float(hit[1].replace(",", "")) if hit else None
                value = repr(number) if number is not None and self.low <= number <= self.high else ""
            else:
                value = "; ".join(name for name, p in self.pattern.items() if re.search(p, window, re.I))
            if value:
                return value, " ".join(window.split())
        return None


def _method(anchor: str, words: frozenset[str]) -> Near:
    return Near(anchor, METHODS, before=220, after=280, words=words, holds=("coat", "slot", "evaporat", "blad", "bath", "cbd", "layer", "ald", "sputter"))


def _thickness(anchor: str, words: frozenset[str]) -> Near:
    return Near(anchor, NANOMETRES, 0.1, 1000, words=words, holds=("nm",))


ANNEAL_WORDS, AREA_WORDS = frozenset({"anneal", "annealing", "annealed"}), frozenset({"area"})
ELECTRON_WORDS, HOLE_WORDS = frozenset({"etl", "electron", "sno2", "tio2", "c60", "pcbm"}), frozenset({"htl", "hole", "spiro", "ptaa", "pedot", "niox"})
CONTACT_WORDS = frozenset({"au", "ag", "al", "cu", "contact", "electrode"})
# Ranges and patterns by field; of several ways the first that finds a value counts.
PRIORITY_FIELDS: dict[str, Sequence[Near]] = {
    "annealing_temperature": (Near(ANNEAL, r"(\d{2,3}(?:\.\d+)?)\s*(?:°\s*C|degrees?\s*C|C\b)", 40, 250, words=ANNEAL_WORDS),),
    "annealing_time": (Near(ANNEAL, r"(\d{1,4}(?:\.\d+)?)\s*(?:min|minutes)\b", 0.1, 600, words=ANNEAL_WORDS, holds=("min",)),),
    "cell_area": (
        Near(AREA, rf"{AREA}[^.\n]{{0,80}}?(\d+(?:\.\d+)?)\s*cm\s*(?:2|\^2|-2)?", 0.001, 20, words=AREA_WORDS, holds=("cm",)),
        Near(AREA, rf"\b(\d+(?:\.\d+)?)\s*cm\s*(?:2|\^2)\b[^.\n]{{0,80}}?{AREA}", 0.001, 20, words=AREA_WORDS, holds=("cm",)),
    ),
    "electron_layer_thickness": (_thickness(ELECTRON_LAYER, ELECTRON_WORDS),),
    "hole_layer_thickness": (_thickness(HOLE_LAYER, HOLE_WORDS),),
    "contact_thickness": (_thickness(CONTACT, CONTACT_WORDS),),
    "electron_layer_method": (_method(ELECTRON_LAYER, ELECTRON_WORDS),),
    "hole_layer_method": (_method(HOLE_LAYER, HOLE_WORDS),),
    "contact_method": (_method(CONTACT, CONTACT_WORDS),),
}
#: The columns of a record that the fields fill.
COLUMNS = {
    "annealing_temperature": "Perovskite_deposition_thermal_annealing_temperature", "annealing_time": "Perovskite_deposition_thermal_annealing_time", "cell_area": "Cell_area_measured",
    "electron_layer_thickness": "ETL_thickness", "hole_layer_thickness": "HTL_thickness_list", "contact_thickness": "Backcontact_thickness_list",
    "electron_layer_method": "ETL_deposition_procedure", "hole_layer_method": "HTL_deposition_procedure", "contact_method": "Backcontact_deposition_procedure",
}
ELECTRON_TERMS = ("TiO2", "SnO2", "PCBM", "C60", "ZnO", "NiOx", "BCP")
HOLE_TERMS = ("Spiro-OMeTAD", "PTAA", "PEDOT:PSS", "NiOx", "CuSCN", "P3HT", "MeO-2PACz", "2PACz")
CONTACT_TERMS = ("Au", "Ag", "Al", "Cu", "ITO", "FTO", "carbon")
#: Words of which a sentence of solvents, and one of the two shapes of a cell, has one ("n" stands for p-i-n and n-i-p).
SOLVENT_WORDS = frozenset({"dmf", "dmso", "nmp", "gbl", "chlorobenzene", "toluene", "antisolvent", "solvent", "solvents"})
SHAPES = {"inverted": (frozenset({"inverted", "pin", "n"}), r"\b(inverted|p-i-n|pin)\b"), "regular": (frozenset({"regular", "nip", "mesoscopic", "planar", "n"}), r"\b(regular|n-i-p|nip|mesoscopic|planar)\b")}
WORD = re.compile("[a-z0-9]+")
APART = bytes(b if bytes([b]).isalnum() else 32 for b in range(256))
TERMS = _of((*ATMOSPHERES, *SOLVENTS, *ADDITIVES, *ELECTRON_TERMS, *HOLE_TERMS, *CONTACT_TERMS))
#: All words that decide whether a pattern is tried.
WANTED = frozenset(
    w.encode() for w in {"unencapsulated", "encapsulated"}.union(SOLVENT_WORDS, *(words for words, _ in TERMS.values()), *(words for words, _ in SHAPES.values()), *(way.words for ways in PRIORITY_FIELDS.values() for way in ways))
)


def _rows_of(df: DataFrame, key: str, read: Sequence[Column], find, columns: str) -> DataFrame:
    """(key, columns): the rows of text that find(values read) gives for each row of df."""
    names = [c.split()[0] for c in columns.split(", ")]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {columns}"

    kinds = [{"string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                at, found = [], []
                for k in range(part.num_rows):
                    for row in find(*(part.column(c)[k].as_py() for c in range(1, part.num_columns))):
                        at.append(k)
                        found.append(row)
                cols = [pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *cols], [key, *names])

    return df.select(key, *(c.alias(f"_read{k}") for k, c in enumerate(read))).mapInArrow(run, schema)


def _near(text: str, low: str, words: set[str], fields: Mapping[str, Sequence[Near]] = PRIORITY_FIELDS) -> Iterator[tuple[str, str, str]]:
    for field, ways in fields.items():
        hit = next((h for h in (way.find(text) for way in ways if way.may_find(low, words)) if h), None)
        if hit:
            yield field, *hit


def fields_near(df: DataFrame, key: str, text: str, fields: Mapping[str, Sequence[Near]] = PRIORITY_FIELDS) -> DataFrame:
    """(key, field, value, snippet): each field of each row that the text around its anchors holds."""

    wanted = frozenset(w.encode() for ways in fields.values() for way in ways for w in way.words)

    def find(value: str):
        low = folded(value)
        yield from _near(value, low, words_of(low, wanted), fields)

    return _rows_of(df, key, [F.coalesce(F.col(text).cast("string"), F.lit(""))], find, "field string, value string, snippet string")


def audit_candidates(df: DataFrame, key: str, text: str, spec: Recovery = AUDITED) -> DataFrame:
    """(key, candidate, snippet): every value in range that stands in a good context and, unless its own match says what it is, in no bad one; one row for each value, the largest first."""

    def find(value: str):
        firsts: dict[float, str] = {}
        for c in candidates(value, spec):
            firsts.setdefault(c["values"][0], c["snippet"])
        return sorted(firsts.items(), reverse=True)

    return _rows_of(df, key, [F.coalesce(F.col(text).cast("string"), F.lit(""))], find, "candidate double, snippet string")


def matching_evidence(df: DataFrame, key: str, text: str, target: str, patterns: Sequence[str], width: int = 180) -> DataFrame:
    """(key, evidence): the text around the first number of the patterns that is the target within 0.05 or 0.2 %; rows without any have none."""

    def find(value: str, number: float | None):
        for m in (m for p in patterns for m in re.finditer(p, value, re.I)) if number is not None else ():
            if abs(float(m[1]) - number) <= max(0.05, abs(number) * 0.002):
                yield (re.sub(r"\s+", " ", value[max(0, m.start() - width) : m.end() + width]).strip(),)
                return

    return _rows_of(df, key, [F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(target).cast("double")], find, "evidence string")


NUMBERS = ("JV_default_PCE", "JV_default_Voc", "JV_default_Jsc", "JV_default_FF", "Stability_PCE_T80", "Stability_PCE_T95", "Stability_PCE_end_of_experiment", "Stability_time_total_exposure", "Stability_PCE_after_1000_h", "Stability_temperature_range", "Stability_relative_humidity_average_value", "Stability_light_intensity")
CONDITIONS = {"Stability_temperature_range": "temperature_c", "Stability_relative_humidity_average_value": "rh_percent", "Stability_light_intensity": "light", "Stability_atmosphere": "atmosphere", "Encapsulation": "encapsulation"}
#: The columns that a text may fill beside JV_default_PCE, in the order of the log.
FILLED = (
    "JV_default_Voc", "JV_default_Jsc", "JV_default_FF", "Perovskite_composition_short_form", "Perovskite_composition_long_form", "ETL_stack_sequence", "HTL_stack_sequence", "Backcontact_stack_sequence", "Cell_architecture", "Cell_stack_sequence",
    *COLUMNS.values(), "Perovskite_deposition_solvents", "Perovskite_deposition_solvents_mixing_ratios", "Perovskite_additives_compounds",
    "Stability_PCE_T80", "Stability_PCE_T95", "Stability_PCE_end_of_experiment", "Stability_time_total_exposure", "Stability_PCE_after_1000_h", *CONDITIONS,
)


def record_of(text: str, has: bool) -> dict[str, tuple[float | str, str]]:
    """(value, evidence) by the column of a record, of all that a text says; has: whether the record has an efficiency."""
    whole = squeezed(text)
    low = folded(whole)
    performance, t80, t95, retained = (next(iter(candidates_in(whole, low, spec)), None) for spec in (PERFORMANCE, LIFETIME, LIFETIME_95, RETAINED))
    out: dict[str, tuple[float | str | None, str]] = {}
    if performance and not has:
        told, sides = performance["snippet"], performance["sides"]
        ff = sides.get("ff")
        out |= {"JV_default_PCE": (performance["values"][0], told), "JV_default_Voc": (sides.get("voc"), told), "JV_default_Jsc": (sides.get("jsc"), told), "JV_default_FF": (ff / 100 if ff is not None and ff > 1 else ff, told)}
    if performance or has:
        out |= _features(text, f"{performance['snippet'] if performance else ''}\n{text}")
    for c, best in (("Stability_PCE_T80", t80), ("Stability_PCE_T95", t95)):
        if best:
            out[c] = best["values"][0], best["snippet"]
    if retained:
        percent, hours = retained["values"]
        out |= {"Stability_PCE_end_of_experiment": (percent, retained["snippet"]), "Stability_time_total_exposure": (hours, retained["snippet"])}
        if 950 <= hours <= 1050:
            out["Stability_PCE_after_1000_h"] = percent, retained["snippet"]
    if t80 or t95 or retained:
        said = conditions_in(whole, low, words_of(low, WANTED))
        out |= {c: (said[k], "") for c, k in CONDITIONS.items()}
    return {c: hit for c, hit in out.items() if hit[0] is not None}


def _features(text: str, feature: str) -> dict[str, tuple[str | None, str]]:
    """What a text and the best snippet in front of it, the feature, say of the making of a device."""
    low = folded(feature)
    words = words_of(low, WANTED)
    form = formula_in(text, low)
    electron, hole, contact = (terms_found(feature, words, t) for t in (ELECTRON_TERMS, HOLE_TERMS, CONTACT_TERMS))
    shape = next((name for name, (some, p) in SHAPES.items() if some & words and re.search(p, feature.lower())), None)
    solvents = solvents_in(feature, words)
    additives = terms_found(feature, words, ADDITIVES)
    stack = f"{electron} / perovskite / {hole} / {contact}" if electron and hole and contact else None
    return {
        "Perovskite_composition_short_form": (form, ""), "Perovskite_composition_long_form": (form, ""), "ETL_stack_sequence": (electron, ""), "HTL_stack_sequence": (hole, ""), "Backcontact_stack_sequence": (contact, ""),
        "Cell_architecture": (shape, ""), "Cell_stack_sequence": (stack, ""), **{COLUMNS[f]: (value, snippet) for f, value, snippet in _near(feature, low, words)},
        "Perovskite_deposition_solvents": (solvents["solvents"], solvents["snippet"]), "Perovskite_deposition_solvents_mixing_ratios": (solvents["ratio"], solvents["snippet"]),
        "Perovskite_additives_compounds": (additives, sentence_in(feature, ADDITIVE_SENTENCE) if additives else ""),
    }


def recover_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with what its text says of empty columns, and `_changes`, an array of (field, value, evidence) of all that was filled; nothing that is there is changed.

    Efficiency (with Voc, Jsc and FF beside it, FF as a fraction) where JV_default_PCE isn't between 5 and 30; then, for
    records that have an efficiency, formula, layers, architecture and the 14 fields of a device's making, from the best
    snippet and the whole text; lifetimes, retention with its hours, retention at 950 to 1,050 hours as
    Stability_PCE_after_1000_h, and test conditions where one of these is found. Columns that df lacks are made. Null and
    empty texts fill nothing. One Python pass reads each text once beside its row, so nothing is joined or shuffled, and
    rows with equal keys or none are filled each from its own text. Evidence is logged whole: a window around a match, or
    the sentence that names a solvent or an additive, however long.
    """
    kind = pa.map_(pa.string(), pa.struct([("number", pa.float64()), ("value", pa.string()), ("evidence", pa.string())]))

    def run(texts: pa.Array, has: pa.Array) -> pa.Array:
        found = (record_of(t.as_py() or "", h.as_py()) for t, h in zip(texts, has))
        return pa.array([[(c, {"number" if c in NUMBERS else "value": value, "evidence": evidence}) for c, (value, evidence) in r.items()] for r in found], kind)

    kept = F.col("JV_default_PCE").cast("double") if "JV_default_PCE" in df.columns else F.lit(None).cast("double")
    told = F.arrow_udf(run, "map<string,struct<number:double,value:string,evidence:string>>")
    rows = df.withColumn("_told", told(F.col(text).cast("string"), F.coalesce(kept.between(5, 30), F.lit(False))))
    rows = rows.withColumns({f"_found{k}": F.try_element_at("_told", F.lit(c)) for k, c in enumerate(("JV_default_PCE", *FILLED))})
    found = {c: (F.col(f"_found{k}")["number" if c in NUMBERS else "value"], F.col(f"_found{k}.evidence")) for k, c in enumerate(("JV_default_PCE", *FILLED))}
    pce, evidence = found.pop("JV_default_PCE")
    new = pce.isNotNull()
    present = lambda c: (F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "") if c in df.columns else F.lit(False)
    filled = {c: ~present(c) & v.isNotNull() for c, (v, _) in found.items()}
    entry = lambda c, when, v, e: F.when(when, F.struct(F.lit(c).alias("field"), v.cast("string").alias("value"), e.alias("evidence")))
    changes = F.array_compact(F.array(entry("JV_default_PCE", new, pce, evidence), *(entry(c, filled[c], *found[c]) for c in found)))
    typed = lambda c, v: v.cast(df.schema[c].dataType) if c in df.columns else v
    made = {"JV_default_PCE": F.coalesce(pce, kept)}
    made |= {c: F.when(filled[c], typed(c, v)).otherwise(F.col(f"`{c}`")) if c in df.columns else F.when(filled[c], v) for c, (v, _) in found.items()}
    return rows.select(*(made.pop(c, F.col(f"`{c}`")).alias(c) for c in df.columns), *(v.alias(c) for c, v in made.items()), changes.alias("_changes"))
