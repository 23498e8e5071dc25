"""Quality rules: distribution divergence from language references, behind minimum lengths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import carried, map_carrying, materialize, parts, table

WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL_RE = re.compile(r"[#*$%&|<>]")
#: Character classes by code point: 0 white space, 1 a-z, 2 A-Z, 3 0-9, 4 sentence marks, 5 other ASCII, 6 beyond ASCII.
CLASSES = 7
SENTENCE_MARKS = ".,;:!?'\"()-"
#: A reference holds this many of a language's most frequent words, of at most so many characters each.
COMMON_WORDS, COMMON_LENGTH = 64, 6
#: Languages with fewer words in the corpus have no reference.
LEAST_LANGUAGE_WORDS = 1000
#: Guards: a document with less than this is not judged by its divergence.
LEAST_WORDS, LEAST_CHARS = 50, 200
#: The largest distances (0 to 1) from the nearest reference that a document may have.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.27, 0.49


def _class_table() -> np.ndarray:
    t = np.full(129, 5, np.uint8)
    t[128] = 6
    for k, chars in ((0, " \t\n\v\f\r"), (1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, SENTENCE_MARKS)):
        t[[ord(c) for c in chars]] = k
    return t


CLASS_OF = _class_table()


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(CLASS_OF[np.minimum(points, 128)], minlength=CLASSES)


def _references_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part of a batch: how often each language has each short word (kind w) and each character class (kind c)."""
    for batch in parts(batches, 1000):
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            text, lang = text.as_py(), lang.as_py()
            found = WORD_RE.findall(text.lower())
            own = words.setdefault(lang, Counter())
            own.update(w for w in found if len(w) <= COMMON_LENGTH)
            own[""] += len(found)
            chars[lang] = chars.get(lang, 0) + char_classes(text)
        rows = [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "c", str(k), int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "item", "n"])


def language_references(docs: DataFrame, common_words: int = COMMON_WORDS) -> dict[str, dict]:
    """From all documents with a language: its character-class shares and the shares of its most frequent short words.

    Counts are combined per batch before they are shuffled; what reaches the driver is common_words + CLASSES + 1 rows
    for each language with enough words.
    """
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInArrow(_references_of, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "references")
    total = (F.col("kind") == "w") & (F.col("item") == "")
    enough = counts.where(total & (F.col("n") >= LEAST_LANGUAGE_WORDS)).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    top = counts.where((F.col("kind") == "w") & (F.col("item") != "")).withColumn("rank", rank).where(F.col("rank") <= common_words).drop("rank")
    rows = top.unionByName(counts.where(total | (F.col("kind") == "c"))).join(enough, "lang", "left_semi").collect()
    found: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["kind"], -r["n"], r["item"])):
        ref = found.setdefault(r["lang"], {"chars": np.zeros(CLASSES), "words": {}, "total": 0})
        if r["kind"] == "c":
            ref["chars"][int(r["item"])] = r["n"]
        elif r["item"]:
            ref["words"][r["item"]] = r["n"]
        else:
            ref["total"] = r["n"]
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2, from 0 (equal) to 1 (nothing in common)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, (p[a] @ np.log2(p[a] / m[a]) + q[b] @ np.log2(q[b] / m[b])) / 2)))


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = WORD_RE.findall(text)
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    n_repeat = 0
    if len(words) > 3:
        ids: dict[str, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        n = len(ids)
        pairs = a[:-1] * n + a[1:]
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * n + a[2:]
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[which] > 1)
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[starts + k] = True
        n_repeat = int(covered.sum())
    return words, sum(map(len, words)), len(SYMBOL_RE.findall(text)), len(lines) - len(set(lines)), n_repeat


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """js_distance of each row of shares p (or of one) from the same row of shares q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum(0, both / 2))


def nearest_reference(references: dict[str, dict]):
    """A function of a text and its words: its distances from the nearest reference, all references looked at at once."""
    langs = sorted(references)
    chars = np.array([references[x]["chars"] / references[x]["chars"].sum() for x in langs]).reshape(-1, CLASSES)
    width = 1 + max((len(references[x]["words"]) for x in langs), default=0)
    shares = np.zeros((len(langs), width))  # of a language's common words, by rank; of all other words in the last column
    places: dict[str, list[tuple[int, int]]] = {}
    for k, x in enumerate(langs):
        words, total = references[x]["words"], references[x]["total"]
        shares[k, : len(words)] = list(words.values())
        shares[k, -1] = total - sum(words.values())
        shares[k] /= total
        for r, w in enumerate(words):
            places.setdefault(w, []).append((k, r))

    def distances(text: str, words: list[str]) -> tuple[float | None, float | None]:
        """From the nearest reference; None where a guard or the lack of references keeps from judging."""
        if len(words) < LEAST_WORDS or len(text) < LEAST_CHARS or not langs:
            return None, None
        own = char_classes(text)
        counts = Counter(filter(places.__contains__, map(str.lower, words)))
        hist = np.zeros((len(langs), width))
        for w, n in counts.items():
            for k, r in places[w]:
                hist[k, r] = n
        hist[:, -1] = len(words) - hist.sum(1)
        by_char, by_word = js_distances(own[None] / own.sum(), chars), js_distances(hist / len(words), shares)
        k = int(np.argmin(by_char + by_word))
        return float(by_char[k]), float(by_word[k])

    return distances


def _judge(references: dict[str, dict]):
    distances = nearest_reference(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 500):
            rows = []
            for text in map(pa.StringScalar.as_py, batch.column(0)):
                words, word_chars, n_symbols, n_dup, n_repeat = base_counts(text)
                failed = len(words) < LEAST_WORDS or 100 * n_repeat > 50 * len(words)
                c, w = distances(text, words)
                kept = not failed and not (c is not None and (c > MOST_CHAR_DISTANCE or w > MOST_WORD_DISTANCE))
                rows.append((len(words), word_chars, n_symbols, n_dup, n_repeat, failed, kept, c, w))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            own = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], *(n for n, _ in RESULT)])

    return run


RESULT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("char_distance", "double"), ("word_distance", "double")]


def quality_verdicts(docs: DataFrame, carry: list[str] | None = None, references: dict[str, dict] | None = None) -> DataFrame:
    """The columns `carry` (all by default), then RESULT, for every document.

    A document fails if it has under 50 words, or if over half of its words lie in three-word windows that it has twice
    or more; else if its character classes or its common words are further than the limits from the nearest language
    reference (Jensen-Shannon distance). Documents too short for the guards are judged by the base rules alone, so is
    everything where no language has a reference (no lang values, empty table). A null text has no words and fails.
    References come from all of docs unless they are given. Each row is judged alone: ties and repeated rows change
    nothing. Columns of docs with a name of RESULT give way to those of the result.
    """
    carry = carried(docs.columns if carry is None else carry, (n for n, _ in RESULT))
    references = language_references(docs) if references is None else references
    return map_carrying(docs, F.coalesce(F.col("text"), F.lit("")), carry, _judge(references), ", ".join(f"{n} {t}" for n, t in RESULT))


def op6_js_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), ["doc_id"])
    return verdicts.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def _op6_sql() -> str:
    marks = SENTENCE_MARKS.replace("'", "''").replace("-", r"\-")
    word = r"[^\x20\x09-\x0D]+"
    classes = [r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", f"[{marks}]", None, r"[^\x00-\x7F]"]
    counted = ", ".join("0" if c is None else f"(length(text) - length(regexp_replace(text, '{c}', '', 'g')))" for c in classes)
    jsd = "sqrt(greatest(0, (sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2))"
    return rf"""
with t as (select doc_id, lang, text is not null as known, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
k as (select *, [{counted}] as c from t),
k2 as (select * exclude (c), c[1:5] || [length(text) - list_sum(c)] || c[7:7] as c from k),
pos as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from t where len(w) > 2),
win as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from pos),
rep as (select doc_id, count(distinct i + j) as n from (select doc_id, i, unnest([0, 1, 2]) as j from win where n > 1) group by doc_id),
base as (
    select k2.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words, length(text) as n_chars, c from k2 left join rep using (doc_id)
), low as (select doc_id, lang, regexp_extract_all(lower(text), '{word}') as w from t where known and lang is not null),
total as (select lang, sum(len(w)) as n from low group by lang having sum(len(w)) >= {LEAST_LANGUAGE_WORDS}),
common as (
    select * from (select lang, item, count(*) as n, row_number() over (partition by lang order by count(*) desc, item) as r from (select lang, unnest(w) as item from low) where length(item) <= {COMMON_LENGTH} group by lang, item)
    where r <= {COMMON_WORDS} and lang in (select lang from total)
), refc as (select lang, k, sum(c[k]) as n from k2, range(1, {CLASSES + 1}) x(k) where known and lang in (select lang from total) group by lang, k),
qc as (select lang, k, n / sum(n) over (partition by lang) as q from refc),
judged as (select doc_id, n_words, n_chars, c from base where n_words >= {LEAST_WORDS} and n_chars >= {LEAST_CHARS}),
dc as (select doc_id, lang, {jsd} as d from (select doc_id, lang, c[k] / n_chars::double as p, q from judged, qc) group by doc_id, lang),
own as (select doc_id, item, count(*) as n from (select doc_id, unnest(list_transform(w, lambda x: lower(x))) as item from t) group by doc_id, item),
hit as (select j.doc_id, m.lang, coalesce(o.n, 0) as n, m.n as m, j.n_words, total.n as total from judged j cross join common m join total using (lang) left join own o on o.doc_id = j.doc_id and o.item = m.item),
hist as (
    select doc_id, lang, n / n_words::double as p, m / total::double as q from hit
    union all select doc_id, lang, (any_value(n_words) - sum(n)) / any_value(n_words)::double, (any_value(total) - sum(m)) / any_value(total)::double from hit group by doc_id, lang
), dw as (select doc_id, lang, {jsd} as d from hist group by doc_id, lang),
near as (select doc_id, c, w from (select dc.doc_id, dc.d as c, dw.d as w, row_number() over (partition by dc.doc_id order by dc.d + dw.d, dc.lang) as r from dc join dw using (doc_id, lang)) where r = 1),
v as (select base.*, near.c as cd, near.w as wd, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed from base left join near using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and coalesce(cd <= {MOST_CHAR_DISTANCE} and wd <= {MOST_WORD_DISTANCE}, true) as kept, round(cd, 6) as char_distance, round(wd, 6) as word_distance from v
"""


OP6_SQL = _op6_sql()
