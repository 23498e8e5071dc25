"""Queries over free text: sentences, claims, terms, overlap; and event windows as an extension."""

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.base import query

CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[\x00\s]+', ' ', 'g'))"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({CLEAN}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) between 35 and 900)"

#: Words of the invented prose, as verbs of claims.
VERBS = (("LINKS", "the"), ("JOINS", "of|and"), ("HAS", "with"))
TERMS = ("and", "the", "der", "les", "para")


@query("sentence_split", f"select doc_id, len({SENTENCES})::bigint as sentences, coalesce(list_sum(list_transform({SENTENCES}, lambda s: length(s))), 0)::bigint as chars from documents")
def sentence_split(t):
    s = T.sentences(F.col("text"))
    return t("documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


def _claims_sql():
    parts = []
    for k, (name, verb) in enumerate(VERBS):
        pattern = rf"(?i)^(.*?)\b(?:{verb})\b(.*)$"
        parts.append(rf"select doc_id, n, {k} as v, '{name}' as predicate, trim(regexp_extract(trim(regexp_extract(s, '{pattern}', 1), ' ,;:-'), '([^;:]*)$', 1)) as b, trim(regexp_extract(trim(regexp_extract(s, '{pattern}', 2), ' ,;:-'), '^([^;]*)', 1)) as a from s where regexp_matches(s, '(?i)\b(?:{verb})\b')")
    return f"""
with s as (select doc_id, unnest({SENTENCES}) as s, unnest(range(0, len({SENTENCES}))) as n from documents), m as ({' union all '.join(parts)}),
r as (select *, row_number() over (partition by doc_id order by n, v) - 1 as claim_no from m where length(a) >= 4 and length(b) >= 4)
select doc_id, claim_no, predicate, array_to_string(list_slice(string_split(b, ' '), greatest(1, len(string_split(b, ' ')) - 35), NULL), ' ') as subject, array_to_string(list_slice(string_split(a, ' '), 1, 42), ' ') as object from r where claim_no < 12"""


@query("claims_from_text", _claims_sql().replace(", NULL)", ", len(string_split(b, ' ')))"))
def claims_from_text(t):
    return T.directional_claims(t("documents").select("doc_id", "text"), "doc_id", "text", VERBS).drop("sentence")


@query("term_hits", "select doc_id, concat_ws('; ', " + ", ".join(rf"case when regexp_matches(coalesce(text, ''), '(?i)(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])') then '{w}' end" for w in TERMS) + ") as hits from documents")
def term_hits(t):
    return t("documents").select("doc_id", T.term_hits(F.coalesce("text", F.lit("")), TERMS).alias("hits"))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9][a-z0-9+\\-]+)', 1), lambda w: not regexp_full_match(w, '\\d+')))"


@query("token_overlap_links", rf"""
with c as (select conv_id, turn, {TOKENS} as w from conversations)
select a.conv_id, a.turn as turn_a, b.turn as turn_b, len(list_intersect(a.w, b.w))::bigint as shared, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::double, 8) as score
from c a join c b on a.conv_id = b.conv_id and a.turn < b.turn where len(list_intersect(a.w, b.w)) >= 2 and len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::double >= 0.24""")
def token_overlap_links(t):
    c = t("conversations").select("conv_id", "turn", T.statement_tokens(F.col("text")).alias("w"))
    j = c.select("conv_id", F.col("turn").alias("turn_a"), F.col("w").alias("wa")).join(c.select("conv_id", F.col("turn").alias("turn_b"), F.col("w").alias("wb")), "conv_id").where("turn_a < turn_b")
    s = j.select("conv_id", "turn_a", "turn_b", F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared"), T.overlap_score(F.col("wa"), F.col("wb")).alias("score"))
    return s.where("shared >= 2 and score >= 0.24").withColumn("score", F.round("score", 8))


@query("keyword_counts", "select doc_id, (" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::bigint" for w in TERMS) + ") as keywords from documents")
def keyword_counts(t):
    return t("documents").select("doc_id", T.term_count(F.col("text"), TERMS).alias("keywords"))


@query("concept_labels", """
select item_id, concat_ws(',', 'ScientificConcept', case when contains(lower(text), 'tion') or contains(lower(text), 'ing') then 'Process' end, case when contains(lower(text), 'ment') then 'Outcome' end) as labels from benchmark""")
def concept_labels(t):
    return t("benchmark").select("item_id", F.array_join(T.concept_labels(F.col("text"), [("Process", ["tion", "ing"]), ("Outcome", ["ment"])]), ",").alias("labels"))


@query("tumbling_event_counts", """
select date_trunc('hour', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_event_counts(t):
    w = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")
