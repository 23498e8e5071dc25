"""Sentences, directional claims, dictionary terms and token overlap as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import clean

#: Verbs of directional claims, in the order in which they are tried.
CLAIM_VERBS = (
    ("IMPROVES", "improve|improves|improved|improving"),
    ("ENHANCES", "enhance|enhances|enhanced|enhancing"),
    ("INCREASES", "increase|increases|increased|increasing|raise|raises|raised"),
    ("REDUCES", "reduce|reduces|reduced|reducing|decrease|decreases|decreased|lower|lowers|lowered"),
    ("PROMOTES", "promote|promotes|promoted|promoting|facilitate|facilitates|facilitated"),
    ("INHIBITS", "inhibit|inhibits|inhibited|suppress|suppresses|suppressed"),
    ("STABILIZES", "stabilize|stabilizes|stabilized|stabilise|stabilises|stabilised"),
    ("ASSOCIATED_WITH", "associated with|correlated with|correlates with|linked to"),
    ("ATTRIBUTED_TO", "attributed to|ascribed to|due to|results? from"),
)
SENTENCE_LENGTHS = (35, 900)
BREAK = "\u0001"


def sentences(text: Column, lengths: tuple[int, int] = SENTENCE_LENGTHS) -> Column:
    """Sentences end at a full stop, question or exclamation mark before white space and a capital or digit; other lengths are dropped."""
    cut = F.split(F.regexp_replace(clean(text), r"([.!?])\s+([A-Z0-9])", f"$1{BREAK}$2"), BREAK)
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: F.length(s).between(*lengths))


def last_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), F.greatest(F.lit(1), F.size(F.split(text, " ")) - n + 1), F.lit(n)), " ")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), F.lit(1), F.lit(n)), " ")


def directional_claims(df: DataFrame, key: str, text: str, verbs: Sequence[tuple[str, str]] = CLAIM_VERBS, most: int = 12, least_length: int = 4) -> DataFrame:
    """(key, claim_no, predicate, subject, object, sentence): the first match of each verb in each sentence, in sentence, then verb order, at most so many a row.

    The clause before the verb goes back to a colon or semicolon and holds its last 36 words, the one after goes on to
    a semicolon and holds its first 42. All inside one row, so there is nothing to shuffle.
    """
    strip = lambda c: F.btrim(c, F.lit(" ,;:-"))

    def found(sentence: Column) -> Column:
        claims = []
        for predicate, verb in verbs:
            pattern = rf"(?i)^(.*?)\b(?:{verb})\b(.*)$"
            before = F.trim(F.regexp_extract(strip(F.regexp_extract(sentence, pattern, 1)), "([^;:]*)$", 1))
            after = F.trim(F.regexp_extract(strip(F.regexp_extract(sentence, pattern, 2)), "^([^;]*)", 1))
            claim = F.struct(F.lit(predicate).alias("predicate"), last_words(before, 36).alias("subject"), first_words(after, 42).alias("object"), sentence.alias("sentence"))
            claims.append(F.when(sentence.rlike(rf"(?i)\b(?:{verb})\b") & (F.length(before) >= least_length) & (F.length(after) >= least_length), claim))
        return F.array_compact(F.array(*claims))

    any_verb = "|".join(verb for _, verb in verbs)  # one look at each sentence; most have no verb at all
    told = F.filter(sentences(F.col(text)), lambda s: s.rlike(rf"(?i)\b(?:{any_verb})\b"))
    claims = F.slice(F.flatten(F.transform(told, found)), 1, most)
    return df.select(key, F.posexplode(claims).alias("claim_no", "claim")).select(key, F.col("claim_no").cast("long").alias("claim_no"), "claim.*")


def statement_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Distinct lower-case tokens of two characters or more, numbers and stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9+\-]+)"), 1)
    kept = F.filter(found, lambda t: ~t.rlike(r"^\d+$") & (~t.isin(*stopwords) if stopwords else F.lit(True)))
    return F.array_distinct(kept)


def overlap_score(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set's size; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur between word boundaries, joined in the order of the list."""
    return F.array_join(F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9])\Q{t}\E(?![A-Za-z0-9])"), t) for t in terms))), "; ")


def term_count(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(t.lower()).cast("long") for t in terms), F.lit(0).cast("long"))


def concept_labels(text: Column, groups: Sequence[tuple[str, Sequence[str]]], base: str = "ScientificConcept") -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(F.lit(base), *(F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(t)), label) for label, terms in groups)))
