"""Queries of rule ladders, policy selection, agreement and attribution over the data tables."""

from pyspark.sql import functions as F

from granary.operators import rules as R
from granary.plans.base import query


@query("weighted_failure_keys", """
with w as (select user_id, event_type, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 5 else 0 end as w from events)
select user_id, sum(w)::bigint as weight, array_to_string(list_sort(list(distinct event_type) filter (where w > 0)), ',') as kinds from w group by user_id having sum(w) >= 10""")
def weighted_failure_keys(t):
    f = R.weighted_failures(t("events"), "user_id", "event_type", {"click": 1, "view": 2, "purchase": 5}, 10)
    return f.select("user_id", F.col("weight").cast("long").alias("weight"), F.array_join("kinds", ",").alias("kinds"))


@query("settings_diff", """
with a as (select c_mktsegment as k, count(*) as v from customer where c_nationkey < 12 group by 1), b as (select c_mktsegment as k, count(*) as v from customer where c_nationkey >= 8 group by 1)
select coalesce(a.k, b.k) as k, a.v as before, b.v as after from a full join b on a.k = b.k where a.v is distinct from b.v""")
def settings_diff(t):
    side = lambda c: t("customer").where(c).groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("v"))
    return R.settings_diff(side("c_nationkey < 12"), side("c_nationkey >= 8"), "k", "v")


@query("representative_cases", """
with e as (select doc_id, 0 as priority, 'short' as mask from documents where n_chars < 200 union all select doc_id, 1, 'long' from documents where n_chars > 3000 union all select doc_id, 2, 'first' from documents where lang = 'en'),
r as (select *, row_number() over (partition by priority order by doc_id) as r from e), o as (select doc_id, arg_min(mask, priority) as mask, min(priority)::int as priority from r where r <= 3 group by doc_id)
select doc_id, priority, mask from o order by priority, doc_id limit 8""")
def representative_cases(t):
    return R.representative_cases(t("documents"), "doc_id", {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 3000, "first": F.col("lang") == "en"})


POLICIES = [("mechanism", 0.4, ["the", "tion"], {"en": 0.3}), ("boundary", 0.5, ["der", "ung"], {"de": 0.4}), ("tradeoff", 0.3, ["les", "ment"], {"fr": 0.2, "es": 0.1})]


@query("policy_selection", """
with p(policy, prior, k1, k2, kinds, bonus) as (values ('mechanism', 0.4::double, 'the', 'tion', ['en'], [0.3::double]), ('boundary', 0.5::double, 'der', 'ung', ['de'], [0.4::double]), ('tradeoff', 0.3::double, 'les', 'ment', ['fr', 'es'], [0.2::double, 0.1::double])),
s as (select doc_id, policy, prior + coalesce(bonus[list_position(kinds, lang)], 0) + least(1.25::double, 0.18::double * (contains(lower(text), k1)::int + contains(lower(text), k2)::int)) as score from documents, p),
r as (select *, row_number() over (partition by doc_id order by score desc, policy) as rank, 0.5::double + 0.45::double * (score / sum(score) over (partition by doc_id)) as confidence from s)
select doc_id, policy, round(score, 6) as score, rank, round(confidence, 6) as confidence from r where rank = 1""")
def policy_selection(t):
    docs = t("documents").select("doc_id", "text", F.col("lang").alias("kind"))
    policies = docs.sparkSession.createDataFrame(POLICIES, "policy string, agent_prior double, keywords array<string>, priors map<string,double>")
    s = R.select_policies(docs, policies, "doc_id", "text")
    return s.select("doc_id", "policy", F.round("score", 6).alias("score"), "rank", F.round("confidence", 6).alias("confidence"))


@query("specific_terms", """
select p_partkey, coalesce(length(p_name) between 3 and 12 and not regexp_matches(lower(p_name), '^(?:a|s)'), false) as specific from part""")
def specific_terms(t):
    return t("part").select("p_partkey", R.specific(F.col("p_name"), ["a", "s"], (3, 12)).alias("specific"))


@query("beeswarm_offsets", """
with s as (select count(p_retailprice) as n, min(p_retailprice) as lo, max(p_retailprice) as hi from part), k as (select greatest(12, least(42, floor(2.8 * sqrt(n))))::int as bins, lo, hi from s),
b as (select p_partkey, floor((p_retailprice - lo) / (hi - lo) * (bins - 1))::bigint as bin from part, k), r as (select *, row_number() over (partition by bin order by p_partkey) as r, count(*) over (partition by bin) as c from b)
select p_partkey, bin, (case when r % 2 = 0 then floor(r / 2.0) else -floor(r / 2.0) end)::double / max(c) over () + 0.0 as "offset" from r""")
def beeswarm_offsets(t):
    return R.beeswarm_offsets(t("part"), "p_retailprice", "p_partkey")


@query("grouped_attribution", """
with v as (select l_orderkey, l_suppkey, l_returnflag as g, case l_returnflag when 'A' then l_tax else -l_discount end as v from lineitem), s as (select l_orderkey, l_suppkey, case when g = 'A' then 'first' else 'rest' end as "group", abs(sum(v)) as a from v group by 1, 2, 3),
b as (select l_suppkey, "group", sum(a) as s, count(*) as n from s group by 1, 2)
select "group", round(sum(s) / sum(n), 8) as mean_abs, round(avg(s / n), 8) as balanced_mean_abs from b group by 1""")
def grouped_attribution(t):
    v = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("feature"), F.when(F.col("l_returnflag") == "A", F.col("l_tax")).otherwise(-F.col("l_discount")).alias("value"))
    groups = v.select("feature").distinct().withColumn("group", F.when(F.col("feature") == "A", "first").otherwise("rest"))
    g = R.grouped_attribution(v, groups, "l_orderkey", "feature", "value", "l_suppkey")
    return g.select("group", F.round("mean_abs", 8).alias("mean_abs"), F.round("balanced_mean_abs", 8).alias("balanced_mean_abs"))


@query("agreement_gate", """
with p as (select p_retailprice as a, p_retailprice * 1.05 + p_size as b from part), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as y from p),
s as (select round(corr(x, y), 8) as spearman from r), m as (select round(corr(a, b), 8) as pearson, round(avg(abs(b - a)) / avg(abs(a)), 8) as relative_mae from p)
select spearman, pearson, relative_mae, spearman >= 0.9 and relative_mae <= 0.25 as passed from s, m""")
def agreement_gate(t):
    g = R.agreement_gate(t("part").select(F.col("p_retailprice").alias("a"), (F.col("p_retailprice") * 1.05 + F.col("p_size")).alias("b")), "a", "b")
    return g.select(*(F.round(c, 8).alias(c) for c in ("spearman", "pearson", "relative_mae")), "passed")


@query("json_paths", """
select event_id, 'k' as path, props::json->>'k' as value from events where props::json->>'k' is not null
union all select event_id, 'deep.list.1', event_type from events""")
def json_paths(t):
    e = t("events")
    nested = e.select("event_id", F.concat(F.lit('{"deep": {"list": [null, "'), "event_type", F.lit('"]}}')).alias("j"))
    flat = R.json_paths(e.select("event_id", F.col("props").alias("j")), "event_id", "j")
    return flat.where("value is not null").union(R.json_paths(nested, "event_id", "j").where("value is not null"))
