"""Queries that check the tables as if they were to be published."""

from pyspark.sql import functions as F

from granary.operators import release as R
from granary.plans.base import query


@query("hygiene_scan", r"""
with f as (select 'docs/' || repeat(coalesce(source, ''), 1 + (doc_id % 40)::int) || '/' || doc_id as path, coalesce(text, '') || case when doc_id % 9 = 0 then ' see C:\\Users\\someone\\x' when doc_id % 9 = 1 then chr(7) when doc_id % 9 = 2 then ' hf_' || repeat('a', 25) else '' end as t from documents)
select path, 'personal absolute path' as issue from f where regexp_matches(replace(replace(replace(t, '\\', '\'), '\\', '\'), '\\', '\'), '(?i)(?:[a-z]:[\\/]+Users[\\/]+[^<\\/\s"'']+|/(?:Users|home)/[^<\s/"'']+)')
union all select path, 'unexpected control character' from f where regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')
union all select path, 'credential pattern' from f where regexp_matches(t, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{25,}|AIza[0-9A-Za-z_-]{35}')
union all select path, 'relative path length ' || length(path) || ' exceeds limit 180' from f where length(path) > 180""")
def hygiene_scan(t):
    i = F.col("doc_id")
    more = F.when(i % 9 == 0, " see C:\\\\Users\\\\someone\\\\x").when(i % 9 == 1, F.char(F.lit(7))).when(i % 9 == 2, " hf_" + "a" * 25).otherwise("")
    path = F.concat(F.lit("docs/"), F.repeat(F.coalesce("source", F.lit("")), (1 + i % 40).cast("int")), F.lit("/"), i)
    return R.hygiene_issues(t("documents").select(path.alias("path"), F.concat(F.coalesce("text", F.lit("")), more).alias("text")), "path", "text")


@query("identity_errors", """
with m as (select doc_id % 900 as k, doc_id % 5 > 0 as tr, doc_id % 5 = 0 and doc_id % 7 > 0 as te from documents), p as (select k from m where te or k % 50 = 1),
t as (select k, count(*) as n from p group by k), g as (select k, count(*) as n, bool_or(tr) as tr, bool_or(te) as te from m group by k),
b as (select coalesce(t.k, g.k) as k, t.n as tests, g.n as members, tr, coalesce(te, false) as te from t full join g on t.k = g.k)
select * from (
    select 'canonical test sample identities collide' as error, count(*) filter (where tests > 1) as keys from b
    union all select 'training identity crosswalk does not follow the sample-key contract', count(*) filter (where k % 100 = 3) from b where members is not null
    union all select 'eligible canonical sample identities collide', count(*) filter (where members > 1) from b
    union all select 'the same canonical sample appears in training and test', count(*) filter (where tests is not null and tr) from b
    union all select 'training audit does not identify every frozen test sample', count(*) filter (where (tests is not null) <> te) from b
) where keys > 0""")
def identity_errors(t):
    i = F.col("doc_id")
    k = (i % 900).cast("string")
    key = F.concat(F.lit("10.1/a"), k, F.lit("|0.0|01|"))
    raw = F.concat(F.when(i % 900 % 100 == 3, "10.1/B").otherwise("doi: 10.1/A"), k, F.lit("|0.0|01|"))
    te = (i % 5 == 0) & (i % 7 > 0)
    m = t("documents").select(raw.alias("raw_row_key"), key.alias("canonical_row_key"), (i % 5 > 0).cast("string").alias("in_training"), te.cast("string").alias("is_frozen_test_sample"))
    p = t("documents").where(te | (i % 900 % 50 == 1)).select(F.concat(F.lit("https://doi.org/"), key).alias("raw_frozen_row_key"), key.alias("canonical_row_key"))
    return R.identity_errors(p, m)


@query("numeric_agreement_by_field", """
with j as (select case doc_id % 4 when 0 then 'JV_default_PCE' when 1 then 'JV_default_Voc' when 2 then 'Cell_area_measured' else 'note' end as field, case when quality = 1 then 'Yes ' else 'no' end as present, case toxic when 1 then 'partial' when 0 then 'YES' end as decision from labels),
k as (select field, decision from j where field <> 'note' and present = 'Yes ' and decision is not null)
select field, count(*) as n, avg((decision = 'YES')::int) as agreement from k group by field union all select '', count(*), avg((decision = 'YES')::int) from k having count(*) > 0""")
def numeric_agreement_by_field(t):
    i = F.col("doc_id") % 4
    field = F.when(i == 0, "JV_default_PCE").when(i == 1, "JV_default_Voc").when(i == 2, "Cell_area_measured").otherwise("note")
    core = t("labels").select(field.alias("field"), F.when(F.col("quality") == 1, "Yes ").otherwise("no").alias("present"), F.when(F.col("toxic") == 1, "partial").when(F.col("toxic") == 0, "YES").alias("decision"))
    return R.numeric_agreement(core, "field", "present", "decision")
