"""Queries of comparisons, gates, audits, sampling and summaries over the data tables."""

from pyspark.sql import functions as F

from granary.operators import graph as G
from granary.operators import reports as R
from granary.plans.base import query


@query("distinct_by_first_identity", """
with k as (select lang, coalesce(case when source is not null and n_chars > 1000 then 'source:' || source end, case when l.quality is not null then 'quality:' || l.quality end) as id from documents left join labels l using (doc_id))
select lang, count(distinct id) as papers, count(*) as rows from k group by lang""")
def distinct_by_first_identity(t):
    j = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return R.distinct_by_first_identity(j, {"source": F.when(F.col("n_chars") > 1000, F.col("source")), "quality": F.col("quality")}, ["lang"])


@query("timing_summary", """
with e as (select event_type as status, value from events)
select status, count(*) as count, round(sum(value) / count(value), 3) as elapsed_avg, round(max(value), 3) as elapsed_max from e group by status
union all select null, count(*), round(sum(value) / count(value), 3), round(max(value), 3) from e""")
def timing_summary(t):
    return R.timing_summary(t("events").select("event_type", "value"), "event_type", "value")


@query("matched_deltas", """
with m as (select o_orderpriority, o_orderstatus, count(*)::double as n, max(o_totalprice) as top from orders group by 1, 2)
select a.o_orderpriority, b.n - a.n as delta_n, b.top - a.top as delta_top from m a join m b using (o_orderpriority) where a.o_orderstatus = 'O' and b.o_orderstatus = 'F'""")
def matched_deltas(t):
    m = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("top"))
    return R.matched_deltas(m, ["o_orderpriority"], "o_orderstatus", "O", "F", ["n", "top"])


@query("support_gate", """
with c as (select o_orderstatus as d, o_orderpriority as p, count(*) as n from orders group by 1, 2), g as (select p, coalesce(max(n) filter (where d = 'F'), 0) - coalesce(max(n) filter (where d = 'P'), 0) as gain from c group by p),
w as (select (select max(gain) from g where p = '1-URGENT') as first_added, (select max(gain) from g where p in ('2-HIGH', '5-LOW')) as rest_added, (select sum(n) > 0 from c) as rows_ok)
select first_added, rest_added, rows_ok, first_added >= 1 as first_ok, rest_added >= 1000000 as rest_ok, case when rows_ok and first_added >= 1 and rest_added >= 1000000 then 'pass' else 'review' end as decision from w""")
def support_gate(t):
    c = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    checks = {"first": (["1-URGENT"], 1), "rest": (["2-HIGH", "5-LOW"], 1_000_000)}
    return R.support_gate(c, "o_orderstatus", "o_orderpriority", "n", "P", "F", checks, {"rows": F.sum("n") > 0})


@query("latest_status_union", """
select user_id, arg_max(event_type, event_id) as status from events group by user_id
union all select c_custkey, 'registry_only' from customer where c_custkey not in (select user_id from events where user_id is not null)""")
def latest_status_union(t):
    return R.latest_status(t("events").select("user_id", "event_type", "event_id"), t("customer").select(F.col("c_custkey").alias("user_id")), "user_id", "event_type", "event_id")


@query("variant_summaries", """
with v as (select 'all' as variant, n_chars, source from documents union all select 'long', n_chars, source from documents where n_chars > 1000 union all select 'english', n_chars, source from documents where lang = 'en')
select variant, count(*) as rows, count(distinct source) as sources, max(n_chars) as longest from v group by variant""")
def variant_summaries(t):
    variants = {"all": F.lit(True), "long": F.col("n_chars") > 1000, "english": F.col("lang") == "en"}
    return R.variant_summaries(t("documents").select("n_chars", "source", "lang"), variants, [F.count("*").alias("rows"), F.count_distinct("source").alias("sources"), F.max("n_chars").alias("longest")])


@query("box_summary", """
select event_type, count(value) as n, min(value) as low, round(quantile_cont(value, 0.25), 8) as q1, round(quantile_cont(value, 0.5), 8) as median, round(quantile_cont(value, 0.75), 8) as q3, max(value) as high from events where value is not null group by 1""")
def box_summary(t):
    return R.box_summary(t("events").select("event_type", "value"), "event_type", "value").withColumns({c: F.round(c, 8) for c in ("q1", "median", "q3")})


@query("fill_rate_shift", " union all ".join(f"""
select '{c}' as "column", count({c}) filter (where not e) / count(*) filter (where not e)::double as base_rate, count({c}) filter (where e) / count(*) filter (where e)::double as added_rate,
    count({c}) filter (where e) / count(*) filter (where e)::double - count({c}) filter (where not e) / count(*) filter (where not e)::double as change,
    abs(count({c}) filter (where e) / count(*) filter (where e)::double - count({c}) filter (where not e) / count(*) filter (where not e)::double) as abs_change
from (select d.*, l.quality, l.toxic, coalesce(d.lang = 'en', false) as e from documents d left join labels l using (doc_id))""" for c in ("source", "quality", "toxic")))
def fill_rate_shift(t):
    j = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left")
    return R.fill_rate_shift(j, F.col("lang") == "en", ["source", "quality", "toxic"])


@query("top_quartile_overlap", """
with v as (select p_partkey, p_retailprice as a, p_size * 10 + p_retailprice / 1000 as b from part), n as (select greatest(1, count(*) // 4) as k from v),
x as (select p_partkey from (select p_partkey, row_number() over (order by a desc, p_partkey) as r from v) where r <= (select k from n)), y as (select p_partkey from (select p_partkey, row_number() over (order by b desc, p_partkey) as r from v) where r <= (select k from n))
select (select count(*) from x) as n_base, count(*) as shared, count(*)::double / (select count(*) from x) as overlap from x join y using (p_partkey)""")
def top_quartile_overlap(t):
    return R.top_overlap(t("part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") * 10 + F.col("p_retailprice") / 1000).alias("b")), "p_partkey", "a", "b")


@query("top_quartile_ties", """
select p_partkey from (select p_partkey, row_number() over (order by p_size desc, p_partkey) as r, count(*) over () as n from part) where r <= greatest(1, n // 4)""")
def top_quartile_ties(t):
    return R.top_share(t("part").select("p_partkey", "p_size"), "p_size", "p_partkey")


@query("scenario_sweep", " union all ".join(f"""
select '{name}' as scenario, count(*) as valid_rows, round(median(v), 6) as median, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.75), 6) as q3 from (select l_quantity * pow(1 + l_discount, {e}) as v from lineitem)""" for name, e in (("base", 1), ("low", 0.5), ("high", 2))))
def scenario_sweep(t):
    values = {"base": 1.0, "low": 0.5, "high": 2.0}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("scenario"), (F.col("l_quantity") * F.pow(1 + F.col("l_discount"), F.lit(e))).alias("v")) for name, e in values.items())))
    b = R.box_summary(t("lineitem").select(each.alias("s")).select("s.*"), "scenario", "v")
    return b.select("scenario", F.col("n").alias("valid_rows"), *(F.round(c, 6).alias(c) for c in ("median", "q1", "q3")))


@query("reviewer_disagreement", """
with j as (select doc_id, quality, toxic, (n_chars > 1000)::int as q2, case when n_chars > 100 then 0 end as t2 from labels join documents using (doc_id))
select doc_id, quality is distinct from q2 as disagree_quality, toxic is distinct from t2 as disagree_toxic, quality is distinct from q2 or toxic is distinct from t2 as disagreement from j""")
def reviewer_disagreement(t):
    j = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", (F.col("n_chars") > 1000).cast("int").alias("q2"), F.when(F.col("n_chars") > 100, 0).alias("t2"))
    return R.disagreements(j, {"quality": ("quality", "q2"), "toxic": ("toxic", "t2")}).select("doc_id", "disagree_quality", "disagree_toxic", "disagreement")


@query("vocabulary_check", """
select 'event_type' as "column", event_type as value, count(*) as rows from events where event_type not in ('click', 'view') group by 2
union all select 'user_id', user_id::varchar, count(*) from events where user_id not in (1, 2, 3) group by 2""")
def vocabulary_check(t):
    return R.invalid_values(t("events").select("event_type", "user_id"), {"event_type": ["click", "view"], "user_id": ["1", "2", "3"]})


@query("golden_differences", """
select o_orderkey, 'o_totalprice' as "column", o_totalprice::varchar as got, null::varchar as want from orders where false
union all select o_orderkey, 'o_orderstatus', o_orderstatus, 'X' from orders where o_orderkey % 7 = 0 and o_orderkey % 11 <> 0
union all select o_orderkey, '<row>', 'present', null from orders where o_orderkey % 11 = 0""")
def golden_differences(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    want = o.where("o_orderkey % 11 <> 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1e-13, "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return R.golden_differences(o, want, "o_orderkey", ["o_totalprice", "o_orderstatus"])


_PARTS = " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {at}, 12))::bigint)::decimal(38,0), 0)::varchar" for at in (1, 13, 25, 37))


@query("value_fingerprint", f"""
with h as (select sha256(coalesce(o_orderkey::varchar, '<null>') || chr(31) || coalesce(printf('%.2f', o_totalprice), '<null>')) as h from orders)
select count(*) as rows, {_PARTS} as fingerprint from h""")
def value_fingerprint(t):
    return R.value_fingerprint(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], digits=2)


@query("table_contracts", """
select 'unique_ids' as contract, count(distinct o_orderkey) = count(*) as passed from orders union all select 'statuses', bool_and(o_orderstatus in ('O', 'F', 'P')) from orders
union all select 'all_urgent', bool_and(o_orderpriority = '1-URGENT') from orders union all select 'positive', min(o_totalprice) > 0 from orders""")
def table_contracts(t):
    return R.table_contracts(t("orders"), {"unique_ids": F.count_distinct("o_orderkey") == F.count("*"), "statuses": F.bool_and(F.col("o_orderstatus").isin("O", "F", "P")), "all_urgent": F.bool_and(F.col("o_orderpriority") == "1-URGENT"), "positive": F.min("o_totalprice") > 0})


@query("observations_with_evidence", """
with o as (select doc_id, field, value from (select doc_id, lang, source, n_chars::varchar as n_chars from documents) unpivot (value for field in (lang, source, n_chars)) where trim(value) <> ''),
e as (select doc_id, case when toxic = 1 then 'n_chars' else 'lang' end as field, quality from labels)
select o.doc_id, o.field, o.value, e.quality as evidence, e.doc_id is not null as has_evidence from o left join e on e.doc_id = o.doc_id and e.field = o.field""")
def observations_with_evidence(t):
    o = G.unpivot_observations(t("documents"), "doc_id", ["lang", "source", "n_chars"])
    e = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "n_chars").otherwise("lang").alias("field"), F.col("quality").alias("evidence"), F.lit(True).alias("has_evidence"))
    return G.attach_evidence(o, e, ["doc_id", "field"]).withColumn("has_evidence", F.coalesce("has_evidence", F.lit(False)))


@query("priority_mapping", """
select l_orderkey, l_linenumber, coalesce('s' || s_suppkey, 'p' || p_partkey) as mapped_to, case when s_suppkey is not null then 'supplier' when p_partkey is not null then 'part' end as mapped_by
from lineitem left join supplier on l_suppkey = s_suppkey and s_nationkey < 10 left join part on l_partkey = p_partkey and p_size < 30""")
def priority_mapping(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    suppliers = t("supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("s"), "s_suppkey").alias("to"))
    parts = t("part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("p"), "p_partkey").alias("to"))
    return R.priority_mapping(li, [(suppliers, "l_suppkey", "to", "supplier"), (parts, "l_partkey", "to", "part")]).drop("l_suppkey", "l_partkey")


@query("gather_by_key", """
select e.event_id as position, e.user_id as c_custkey, c.c_mktsegment from events e left join customer c on c.c_custkey = e.user_id""")
def gather_by_key(t):
    return R.gather_by_key(t("events").select(F.col("event_id").alias("position"), F.col("user_id").alias("c_custkey")), t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", "position")


@query("capped_strata_sample", """
with o as (select o_orderkey, o_custkey::varchar as g, md5('42:' || o_orderkey) as o, o_orderpriority = '1-URGENT' as a, o_orderstatus = 'F' as b from orders),
x as (select * from (select *, row_number() over (partition by g order by o, o_orderkey) as r from o where a) where r <= 2 order by o, o_orderkey limit 20), u as (select g, count(*) as used from x group by g),
y as (select * from (select o.*, row_number() over (partition by o.g order by o.o, o.o_orderkey) as r, coalesce(u.used, 0) as used from o left join u on u.g = o.g where b and o_orderkey not in (select o_orderkey from x)) where r <= 2 - used order by o, o_orderkey limit 10),
z as (select o_orderkey, 'urgent' as stratum, row_number() over (order by o, o_orderkey) as place from x union all select o_orderkey, 'filled', 20 + row_number() over (order by o, o_orderkey) from y)
select o_orderkey, stratum, place, printf('VAL%03d', place) as id from z""")
def capped_strata_sample(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return R.capped_strata_sample(o, "o_orderkey", F.col("o_custkey"), {"urgent": (F.col("o_orderpriority") == "1-URGENT", 20), "filled": (F.col("o_orderstatus") == "F", 10)}, per_group=2)


@query("hash_sample", "select c_custkey from customer order by md5('42:' || c_custkey), c_custkey limit 25")
def hash_sample(t):
    return R.hash_sample(t("customer").select("c_custkey"), "c_custkey", 25)


READY = {"target": "n_chars between 100 and 5000", "kind": "lang is not null", "graded": "quality is not null"}


@query("readiness_ladder", f"""
with f as (select doc_id, coalesce({READY['target']}, false) as target, {READY['kind']} as kind, {READY['graded']} as graded from documents left join labels using (doc_id))
select *, target and (kind or graded) as minimal, target and (kind or graded) and kind and graded as strict from f""")
def readiness_ladder(t):
    j = t("documents").select("doc_id", "n_chars", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return R.readiness(j, {name: F.expr(c) for name, c in READY.items()}, {"minimal": "target and (kind or graded)", "strict": "minimal and kind and graded"}).select("doc_id", *READY, "minimal", "strict")


@query("weighted_route", """
with s as (select doc_id, (case when n_chars > 500 then 2.0 else 0 end + case when lang = 'en' then 3.0 else 0 end + case when regexp_matches(lower(text), 'lorem|the ') then 1.5 else 0 end + case when n_chars < 100 then -4.0 else 0 end)::double as score from documents)
select doc_id, score, case when score >= 5 then 'extract' when score >= 2 then 'review' else 'skip' end as route from s""")
def weighted_route(t):
    score, route = R.weighted_route({"long": (F.col("n_chars") > 500, 2), "english": (F.col("lang") == "en", 3), "words": (F.lower("text").rlike("lorem|the "), 1.5), "short": (F.col("n_chars") < 100, -4)}, [("review", 2), ("extract", 5)], "skip")
    return t("documents").select("doc_id", score.alias("score"), route.alias("route"))


WORDS_SQL = "string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("source_alignment", f"""
with d as (select doc_id, text, lang, list_filter(list_distinct({WORDS_SQL.format("text[1:80]")}), lambda w: length(w) >= 4) as title, {WORDS_SQL.format("text[41:]")} as body from documents),
c as (select doc_id, text, lang, len(title) as tokens, len(list_intersect(title, body)) as matched, len(list_filter(body, lambda w: starts_with(w, 'th'))) as domain, len(list_filter(body, lambda w: w = 'of')) as terms, len(list_filter(body, lambda w: w = 'und')) as alien from d)
select doc_id, tokens, matched, case when coalesce(text, '') = '' then 'fail_no_ranked_source_text' when alien > 0 and not (domain >= 3 and terms >= 2) then 'fail_foreign_domain' when not (domain >= 3 and terms >= 2) then 'fail_target_domain'
    when lang = 'de' or (matched >= case when tokens <= 5 then 2 else 3 end and coalesce(matched / nullif(tokens, 0)::double, 0) >= 0.4) then 'pass' else 'review_identity_unconfirmed' end as status from c""")
def source_alignment(t):
    body = F.col("text").substr(F.lit(41), F.length("text"))
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    d = t("documents").select("doc_id", "text", "lang", R.token_coverage(F.substring("text", 1, 80), body).alias("title"), words.alias("w"))
    count = lambda f: F.size(F.filter("w", f))
    status = R.source_alignment(F.coalesce("text", F.lit("")) != "", F.coalesce(F.col("lang") == "de", F.lit(False)), F.col("title"), count(lambda w: w.startswith("th")), count(lambda w: w == "of"), count(lambda w: w == "und"))
    return d.select("doc_id", F.col("title.tokens").cast("long").alias("tokens"), F.col("title.matched").cast("long").alias("matched"), status.alias("status"))


@query("output_flags", r"""
select conv_id, turn, array_to_string(list_filter([case when p = 'humean_evidence' and not regexp_matches(x, 'evidence|reported|observed') then 'missing_explicit_evidence_grounding' end, case when p = 'humean_evidence' and not regexp_matches(x, 'interpret|suggest') then 'direct_evidence_and_interpretation_not_separated' end,
    case when p = 'cartesian_decomposition' and not regexp_matches(x, '\b(step|first|second|third|input|output|calculate|fit)\b') then 'missing_stepwise_decomposition' end], lambda f: f is not null), ',') as flags
from (select conv_id, turn, case when role = 'user' then 'humean_evidence' else 'cartesian_decomposition' end as p, lower(coalesce(text, '')) as x from conversations)""")
def output_flags(t):
    policy = F.when(F.col("role") == "user", "humean_evidence").otherwise("cartesian_decomposition")
    return t("conversations").select("conv_id", "turn", F.array_join(R.output_flags(policy, F.col("text")), ",").alias("flags"))


@query("copy_context", """
with d as (select doc_id, source, case when doc_id % 3 = 0 then n_chars end as target, case when doc_id % 3 <> 0 then lang end as kind from documents),
g as (select source, arg_min(kind, doc_id) filter (where kind is not null) as kind from d where source is not null and target is null group by source)
select d.doc_id, d.source, d.target, coalesce(d.kind, g.kind) as kind from d left join g on g.source = d.source where d.source is not null and target is not null
union all select doc_id, source, target, kind from d where source is null or (target is null and source not in (select source from d where target is not null and source is not null))""")
def copy_context(t):
    from granary.operators.identity import copy_context as copied

    third = F.col("doc_id") % 3 == 0
    d = t("documents").select("doc_id", "source", F.when(third, F.col("n_chars")).alias("target"), F.when(~third, F.col("lang")).alias("kind"))
    return copied(d, "source", ["target"], ["kind"], "doc_id")
