"""Queries that make records of one device, paper or sample one, and lay out what annotators judge."""

from pyspark.sql import functions as F

from granary.operators import integration as I
from granary.operators import models as L
from granary.operators import splits as S
from granary.plans.base import query

#: documents as device records: a value for most, sentences that speak of a control or a treated device and state the value or another one.
RECORDS = """(
select doc_id, source, lang, case when doc_id % 7 <> 6 then (coalesce(n_chars, 0) % 40) / 4.0::double end as pce, (doc_id % 11) / 2.0::double as gap, case when doc_id % 3 > 0 then 'stack ' || doc_id % 4 end as stack,
    coalesce(source, '') || '_d' || case when doc_id % 2 = 0 then '_control_pce_1p50' else '' end as id,
    case doc_id % 4 when 0 then 'The control device' when 1 then 'The champion device' when 2 then 'A device' end as who, doc_id % 5 > 0 as states
from documents)"""
SENTENCES = f"""(
select *, who || ' reached ' || pce || ' %.' as pce_said, case when doc_id % 6 > 0 then case when doc_id % 10 > 4 then 'The pristine film' else 'The passivated film' end || ' has ' || case when states then gap::varchar else 'no such' end || ' gap.' end as gap_said from {RECORDS})"""
ROLE = {"control": r"(?i)\b(control|reference|pristine|untreated|unmodified|bare)\b", "treated": r"(?i)\b(champion|optimi[sz]ed|passivat\w*|treated|modified|target)\b"}


def _role_sql(c):
    a, b = (f"coalesce(regexp_matches({c}, '{p}'), false)" for p in ROLE.values())
    return f"case when {a} and not {b} then 'control' when {b} and not {a} then 'treated' end"


def _records(t):
    d = t("documents")
    i = F.col("doc_id")
    pce, gap = F.when(i % 7 != 6, (F.coalesce("n_chars", F.lit(0)) % 40) / 4.0), (i % 11) / 2.0
    who = F.when(i % 4 == 0, "The control device").when(i % 4 == 1, "The champion device").when(i % 4 == 2, "A device")
    film = F.when(i % 10 > 4, "The pristine film").otherwise("The passivated film")
    said = F.when(i % 5 > 0, gap.cast("string")).otherwise("no such")
    return d.select(
        "doc_id", "source", "lang", pce.alias("pce"), gap.alias("gap"), F.when(i % 3 > 0, F.concat(F.lit("stack "), (i % 4).cast("string"))).alias("stack"),
        F.concat(F.coalesce("source", F.lit("")), F.lit("_d"), F.when(i % 2 == 0, "_control_pce_1p50").otherwise("")).alias("id"),
        F.concat(who, F.lit(" reached "), pce.cast("string"), F.lit(" %.")).alias("pce_said"), F.when(i % 6 > 0, F.concat(film, F.lit(" has "), said, F.lit(" gap."))).alias("gap_said"),
    )


@query("collapsed_devices", f"""
with r as (select *, {_role_sql('pce_said')} as kind, {_role_sql('gap_said')} as gap_kind, {_role_sql('pce_said')} as own from {SENTENCES}),
m as (
    select *, struct_pack(a := -(case when gap_kind = kind then 2 when gap_kind is not null and kind is not null then 0 else 1 end), b := not (states and gap_said is not null), c := doc_id) as gap_rank,
        struct_pack(a := -(case when kind is not null then 2 else 1 end), b := pce_said is null, c := doc_id) as pce_rank
    from r where pce is not null
)
select source, lang, pce, arg_min(gap, gap_rank) as gap, arg_min(gap_said, gap_rank) filter (where gap_said is not null) as gap_said, arg_min(pce_said, pce_rank) filter (where pce_said is not null) as pce_said,
    arg_min(stack, doc_id) filter (where stack is not null) as stack, min(doc_id) as doc_id,
    case when count(*) > 1 then regexp_replace(arg_min(id, doc_id), '_control_pce_1p50$', '') || case when count(*) filter (where kind = 'control') > 0 and count(*) filter (where kind = 'treated') = 0 then '_control' else '_target' end || '_pce_' || replace(format('{{:.2f}}', pce), '.', 'p') else arg_min(id, doc_id) end as id,
    case when count(*) > 1 then 'Collapsed ' || count(*) || ' duplicate rows of one device' end as warning
from m group by source, lang, pce
union all
select source, lang, pce, gap, gap_said, pce_said, stack, doc_id, id, null from r where pce is null""")
def collapsed_devices(t):
    return I.collapse_devices(_records(t), ["source", "lang", "pce"], "id", "pce", "doc_id", {"pce": "pce_said", "gap": "gap_said"})


@query("merged_devices", f"""
with r as (select source, id || '_' || coalesce(n, 0) as id, r.doc_id, pce, stack, gap, gap_said from {SENTENCES} r join (select doc_id, n_chars // 100 as n from documents) using (doc_id)),
a as (select source, id, coalesce(min(pce) <> max(pce), false) or coalesce(min(stack) <> max(stack), false) as apart from r where source is not null group by source, id),
m as (select r.*, case when apart then pce end as p, case when apart then stack end as s from r join a using (source, id))
select source, id, min(doc_id) as doc_id, arg_min(pce, doc_id) filter (where pce is not null) as pce, arg_min(stack, doc_id) filter (where stack is not null) as stack,
    arg_min(gap, struct_pack(a := gap_said is null, b := doc_id)) as gap, arg_min(gap_said, doc_id) filter (where gap_said is not null) as gap_said
from m group by source, id, p, s
union all select source, id, doc_id, pce, stack, gap, gap_said from r where source is null""")
def merged_devices(t):
    n = t("documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("long").alias("n"))
    r = _records(t).join(n, "doc_id").select("source", F.concat("id", F.lit("_"), F.coalesce("n", F.lit(0)).cast("string")).alias("id"), "doc_id", "pce", "stack", "gap", "gap_said")
    return I.merge_same_device(r, ["source", "id"], ["pce", "stack"], "doc_id", {"gap": "gap_said"})


EMPTIED = "select doc_id, source, case when doc_id % 3 = 0 then ' n/a ' when doc_id % 3 = 1 then lang end as lang, case when doc_id % 2 = 0 then n_chars end as n_chars from documents"


def _emptied(t):
    i = F.col("doc_id")
    return t("documents").select("doc_id", "source", F.when(i % 3 == 0, " n/a ").when(i % 3 == 1, F.col("lang")).alias("lang"), F.when(i % 2 == 0, F.col("n_chars")).alias("n_chars"))


def _incoming(t):
    return t("documents").select("source", "lang", "n_chars", "doc_id")


GIVEN = "select source, arg_min(lang, doc_id) filter (where trim(lang) <> '' and lower(trim(lang)) <> 'n/a') as in_lang, arg_min(n_chars, doc_id) filter (where n_chars is not null) as in_n from documents where source is not null group by source"


@query("backfilled_rows", f"with e as ({EMPTIED}), g as ({GIVEN}) select doc_id, e.source, case when trim(lang) not in ('', 'n/a') then lang else coalesce(in_lang, lang) end as lang, coalesce(n_chars, in_n) as n_chars from e left join g using (source)")
def backfilled_rows(t):
    return I.backfill_empty(_emptied(t), _incoming(t), "source", ["lang", "n_chars"], "doc_id")[0]


@query("backfill_report", f"""
with e as ({EMPTIED}), g as ({GIVEN})
select source, 'lang' as "column", in_lang as value, count(*) as n from e join g using (source) where coalesce(trim(lang), '') in ('', 'n/a') and in_lang is not null group by all
union all select source, 'n_chars', in_n::varchar, count(*) from e join g using (source) where n_chars is null and in_n is not null group by all""")
def backfill_report(t):
    report = I.backfill_empty(_emptied(t), _incoming(t), "source", ["lang", "n_chars"], "doc_id")[1]
    return report.groupBy("source", "column", "value").agg(F.count("*").alias("n"))


STATUS = "case when quality = 1 and toxic = 0 then 'accepted' when quality = 1 then 'weak_accepted' when doc_id % 4 = 0 then 'sparse_accepted' when doc_id % 4 < 3 then 'rejected' end"


@query("integration_outcomes", f"""
with s as (select source, {STATUS} as status from labels join documents using (doc_id))
select source, count(*) filter (where status like '%accepted') as accepted_total, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'weak_accepted') as weak_accepted,
    count(*) filter (where status = 'sparse_accepted') as sparse_accepted, count(*) filter (where status = 'rejected') as rejected, count(status) as audited from s group by source""")
def integration_outcomes(t):
    audit = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select("source", F.expr(STATUS).alias("status"))
    return I.integration_outcomes(audit.groupBy("source"))


@query("annotation_tables", """
with e as (
    select doc_id, field, arg_min(evidence, seq) as evidence from (
        select doc_id, 'lang' as field, 'the quality is ' || quality as evidence, 2 as seq from labels where quality = 1
        union all select doc_id, 'lang', 'no toxic words: ' || toxic, 1 from labels where toxic = 0
        union all select doc_id, 'source', 'labelled ' || doc_id, 1 from labels where doc_id % 2 = 0
    ) group by doc_id, field
), r as (
    select doc_id, 'core' as kind, 'text' as family, 'lang' as field, coalesce(lang, '') as value from documents
    union all select doc_id, 'core', 'text', 'absent', '' from documents
    union all select doc_id, 'core', 'size', 'n_chars', coalesce(n_chars::varchar, '') from documents
    union all select doc_id, 'populated', '', 'source', source from documents where source <> ''
)
select r.doc_id, '10.1/d' || r.doc_id as doi, 's' || r.doc_id % 5 as sample_id, kind, family, r.field, value, coalesce(evidence, '') as evidence from r left join e on e.doc_id = r.doc_id and e.field = r.field""")
def annotation_tables(t):
    names = (F.concat(F.lit("10.1/D"), F.col("doc_id")), F.concat(F.lit("s"), F.col("doc_id") % 5))
    sample = t("documents").select("doc_id", names[0].alias("doi"), names[1].alias("sample"), "lang", "n_chars", "source", F.lit("x").alias("_hidden"))
    say = lambda when, field, text, seq: F.when(when, F.struct(F.lit(field).alias("field"), text.alias("evidence"), F.lit(seq).alias("seq")))
    told = F.array_compact(F.array(
        say(F.col("quality") == 1, "lang", F.concat(F.lit("the quality is "), F.col("quality")), 2), say(F.col("toxic") == 0, "lang", F.concat(F.lit("no toxic words: "), F.col("toxic")), 1), say(F.col("doc_id") % 2 == 0, "source", F.concat(F.lit("labelled "), F.col("doc_id")), 1),
    ))
    evidence = t("labels").select(F.lower(names[0]).alias("doi"), names[1].alias("sample_id"), F.inline(told))
    return I.annotation_tables(sample, "doc_id", "doi", "sample", {"text": ["lang", "absent"], "size": ["n_chars"]}, evidence)


@query("wide_fractions", """
with w as (select doc_id, case doc_id % 4 when 0 then 'MA; FA' when 1 then 'Cs' when 2 then 'MA;Cs;FA' end as ions, case doc_id % 4 when 0 then '1;' || (doc_id % 3) when 1 then '0.5' when 2 then case when doc_id % 3 = 0 then '1;2' else '1;2;' || (doc_id % 7) end end as c from documents),
p as (select *, string_split(c, ';') as k, case when doc_id % 4 = 3 or doc_id % 4 = 2 and doc_id % 3 = 0 then false else true end as ok, list_sum(list_transform(string_split(c, ';'), lambda x: x::double)) as total from w)
select doc_id, ions, c as coefficients, case when ok then case doc_id % 4 when 1 then 1.0 when 2 then k[2]::double / total else 0.0 end end as "SCI_A_Cs_fraction",
    case when ok then case doc_id % 4 when 0 then k[2]::double / total when 2 then k[3]::double / total else 0.0 end end as "SCI_A_FA_fraction",
    case when ok then case doc_id % 4 when 1 then 0.0 else k[1]::double / total end end as "SCI_A_MA_fraction", ok::int::double as "SCI_A_valid" from p""")
def wide_fractions(t):
    i = F.col("doc_id")
    ions = F.when(i % 4 == 0, "MA; FA").when(i % 4 == 1, "Cs").when(i % 4 == 2, "MA;Cs;FA")
    c = F.when(i % 4 == 0, F.concat(F.lit("1;"), i % 3)).when(i % 4 == 1, "0.5").when(i % 4 == 2, F.when(i % 3 == 0, "1;2").otherwise(F.concat(F.lit("1;2;"), i % 7)))
    return I.wide_fractions(t("documents").select("doc_id", ions.alias("ions"), c.alias("coefficients")), "ions", "coefficients", "SCI_A")


@query("model_support", """
with y as (select lang, 'quality' as target, 'classification' as task, case when quality in (0, 1) then quality end as y from documents join labels using (doc_id)
    union all select lang, 'toxic', 'classification', case when toxic in (0, 1) then toxic end from documents join labels using (doc_id) union all select lang, 'n_chars', 'regression', n_chars from documents)
select coalesce(lang, '') as lang, target, count(y) as n, case when task = 'regression' and count(y) >= 300 or task = 'classification' and count(y) >= 300 and least(sum((y = 1)::int), sum((y = 0)::int)) >= 40 then 'trained'
    when task = 'regression' then 'skipped_insufficient_rows' else 'skipped_insufficient_class_support' end as status
from y group by lang, target, task""")
def model_support(t):
    """Which target could be modelled for each language, without fitting anything."""
    rows = t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    labelled = rows.join(t("labels"), "doc_id")
    parts = [L.support_by(labelled, ["lang"], "quality", "classification"), L.support_by(labelled, ["lang"], "toxic", "classification"), L.support_by(rows, ["lang"], "n_chars")]
    return parts[0].union(parts[1]).union(parts[2]).select("lang", "target", "n", "status")


@query("stage_one_as_feature")
def stage_one_as_feature(t):
    """Quality of labelled documents as a feature of all: out-of-fold for those that have a label, by a model of all these for the others."""
    text = F.coalesce("text", F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, "#$%&*|<>", ""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    d = t("documents").select("doc_id", "lang", F.length(text).cast("double").alias("size"), marks.cast("double").alias("marks"), (F.length(text) / F.greatest(words, F.lit(1))).alias("word_length"), S.hash_group_fold(F.coalesce("source", F.lit("")), 5).alias("fold"))
    rows = d.join(t("labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    told = L.out_of_fold(rows, ["size", "marks", "word_length", "lang"], "quality", "fold", 5, ["lang"], "classification", outside=True)
    return told.select("doc_id", "fold", "quality", F.round("oof", 9).alias("stage_1_quality"))
