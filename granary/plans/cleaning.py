"""Cleaning, identity, coverage and cohort queries over the data tables."""

from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.operators import identity as I
from granary.operators import quality as Q
from granary.plans.base import query

NORM_TEXT = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


def _text_key(c="text"):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


@query("norm_url_key", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.|blog\.)?', ''), '[?#].*$', ''), '/+$', '') as url_key from pages""")
def norm_url_key(t):
    return t("pages").select("page_id", N.url_key("url").alias("url_key"))


@query("duplicate_urls", r"""
with k as (select page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.|blog\.)?', ''), '[?#].*$', ''), '/+$', '') as url_key from pages)
select url_key, count(*) as pages, min(page_id) as first_page from k group by url_key having count(*) > 1""")
def duplicate_urls(t):
    keys = t("pages").select("page_id", N.url_key("url").alias("url_key"))
    return keys.groupBy("url_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query("title_key_dedupe_first", f"""
with k as (select doc_id, {NORM_TEXT} as key from documents)
select doc_id, length(key)::bigint as key_length from (select *, row_number() over (partition by key order by doc_id) as r from k where length(key) >= 24) where r = 1""")
def title_key_dedupe_first(t):
    keyed = t("documents").select("doc_id", N.normalize_title("text").alias("key")).where("key is not null")
    # the key is as long as the text, so rows are grouped by its digest
    return I.keep_first(keyed.select("doc_id", F.length("key").cast("long").alias("key_length"), F.sha2("key", 256).alias("h")), ["h"], ["doc_id"]).drop("h")


QUALITY_SQL = f"""
with k as (select d.doc_id, d.source, n_chars, l.quality, {NORM_TEXT} as key from documents d left join labels l using (doc_id))"""


def _quality_rows(t):
    docs, labels = t("documents"), t("labels")
    keyed = docs.select("doc_id", "source", "n_chars", F.sha2(_text_key(), 256).alias("key"))
    return keyed.join(labels.select("doc_id", "quality"), "doc_id", "left")


def _best():
    return [F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id"]


@query("best_quality_dedupe", QUALITY_SQL + """
select doc_id, source, n_chars, quality from (select *, row_number() over (partition by key order by quality desc nulls last, n_chars desc, doc_id) as r from k) where r = 1""")
def best_quality_dedupe(t):
    return I.keep_first(_quality_rows(t), ["key"], _best()).select("doc_id", "source", "n_chars", "quality")


@query("duplicate_report", QUALITY_SQL + """
select doc_id, group_size, group_rank, group_rank = 1 as selected from (
    select doc_id, count(*) over (partition by key) as group_size, row_number() over (partition by key order by quality desc nulls last, n_chars desc, doc_id) as group_rank from k) where group_size > 1""")
def duplicate_report(t):
    return I.duplicate_report(_quality_rows(t), ["key"], _best()).where("group_size > 1").select("doc_id", "group_size", "group_rank", "selected")


COVERED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("column_coverage_long", "with j as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))\n" + " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is not null and lower(trim({c}::varchar)) not in {N.MISSING}) as present, count(*) as rows, (count(*) filter (where {c} is not null and lower(trim({c}::varchar)) not in {N.MISSING}))::double / count(*) as fraction from j" for c in COVERED))
def column_coverage_long(t):
    return Q.column_coverage(t("documents").join(t("labels"), "doc_id", "left"), COVERED)


@query("field_group_coverage", """
select d.source, count(*) as rows, count(*) filter (where quality is not null or toxic is not null) as any_label, count(*) filter (where lang is not null and n_chars is not null) as all_meta
from documents d left join labels l using (doc_id) group by d.source""")
def field_group_coverage(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    some, every = Q.group_coverage({"any_label": ["quality", "toxic"]}), Q.group_coverage({"all_meta": ["lang", "n_chars"]}, every=True)
    return j.groupBy("source").agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in {**some, **every}.items()))


@query("completeness_filter_by_source", """
with j as (select d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id)),
s as (select source, count(lang) / count(*) >= 0.3 as a, count(n_chars) / count(*) >= 0.3 as b, count(quality) / count(*) >= 0.3 as c, count(toxic) / count(*) >= 0.3 as d from j group by source),
f as (select j.doc_id, s.source, (a::int + b::int + c::int + d::int)::bigint as counted_columns,
    ((a and lang is not null)::int + (b and n_chars is not null)::int + (c and quality is not null)::int + (d and toxic is not null)::int)::double as filled from j join s on s.source is not distinct from j.source)
select doc_id, source, filled / counted_columns as fill_ratio, counted_columns from f where counted_columns > 0 and filled / counted_columns >= 0.6""")
def completeness_filter_by_source(t):
    j = t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return Q.completeness_filter(j, ["lang", "n_chars", "quality", "toxic"], "source", 0.3, 0.6).select("doc_id", "source", "fill_ratio", "counted_columns")


@query("cohort_summary_overlapping", """
with c as (select lang as cohort, n_chars, source from documents union all select 'all', n_chars, source from documents)
select cohort, count(*) as rows, round(avg(n_chars), 6) as mean, quantile_cont(n_chars, 0.5)::double as median, round(stddev_samp(n_chars), 6) as std, quantile_cont(n_chars, 0.25)::double as q25, quantile_cont(n_chars, 0.75)::double as q75, count(distinct source) as groups from c group by cohort""")
def cohort_summary_overlapping(t):
    s = Q.cohort_summary(t("documents"), F.array("lang", F.lit("all")), "n_chars", "source")
    return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("value_counts_normalized", """
select event_type as value, count(*) as count, count(*)::double / sum(count(*)) over () as share from events group by event_type""")
def value_counts_normalized(t):
    return Q.value_counts(t("events"), "event_type")


@query("list_cell_counts", r"""
select item, count(*) as count from (select unnest(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''))) as item from part) group by item""")
def list_cell_counts(t):
    return Q.list_value_counts(t("part"), N.list_cell("p_name", " "))


@query("year_filter_report", """
with y as (select try_cast(nullif(regexp_extract(o_orderdate::varchar, '((?:19|20)\\d{2})', 1), '') as int) as y from orders)
select count(*) as rows, count(y) as known, count(*) filter (where y is null) as unknown, count(*) filter (where y >= 1996) as kept_known, count(*) filter (where y < 1996) as dropped, min(y)::bigint as first_year from y""".replace("\\\\", "\\"))
def year_filter_report(t):
    return Q.year_report(t("orders"), N.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")), 1996)


@query("midpoint_parse", """
select p_partkey, (p_size + p_size + 10) / 2.0::double as midpoint, p_size::double as single, -p_size::double as negative, p_retailprice as plus_minus from part""")
def midpoint_parse(t):
    p = t("part")
    span = F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"))
    return p.select("p_partkey", N.numeric_midpoint(span).alias("midpoint"), N.numeric_midpoint(F.concat("p_size", F.lit(" nm"))).alias("single"), N.numeric_midpoint(F.concat(F.lit("-"), F.col("p_size"))).alias("negative"), N.numeric_midpoint(F.concat(F.col("p_retailprice"), F.lit(" ± 3.5"))).alias("plus_minus"))


@query("normalized_names", r"""
select p_partkey, lower(trim(regexp_replace(replace(p_brand || ' / ' || p_type || ' 5%', '%', ' percent '), '[^A-Za-z0-9]+', '_', 'g'), '_')) as name from part""")
def normalized_names(t):
    return t("part").select("p_partkey", N.normalize_name(F.concat("p_brand", F.lit(" / "), "p_type", F.lit(" 5%"))).alias("name"))


@query("stable_row_ids", """
select c_custkey, 'customer:' || substr(sha1(lower(c_name) || chr(31) || lower(c_mktsegment)), 1, 20) as id, c_custkey || '|' || c_nationkey || '|' || c_mktsegment as row_key from customer""")
def stable_row_ids(t):
    c = t("customer")
    return c.select("c_custkey", N.stable_id("customer", "c_name", "c_mktsegment").alias("id"), N.row_key("c_custkey", "c_nationkey", "c_mktsegment").alias("row_key"))


@query("first_examples_per_brand", """
with f as (select p_brand, p_type, min(p_partkey) as k from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by k, p_type) as r from f)
select p_brand, string_agg(p_type, '; ' order by r) as examples from r where r <= 5 group by p_brand""")
def first_examples_per_brand(t):
    return Q.first_examples(t("part"), "p_brand", "p_type", "p_partkey")


@query("top_states_per_family", """
with c as (select p_brand, p_type, count(*) as count, count(distinct p_size) as groups from part group by 1, 2 having count(*) >= 2),
r as (select *, row_number() over (partition by p_brand order by count desc, groups desc, p_type) as rank from c)
select * from r where rank <= 3""")
def top_states_per_family(t):
    return Q.top_per_family(t("part"), "p_brand", "p_type", "p_size", 2)


@query("top_quantile_gap_flag", """
with c as (select p_brand, quantile_cont(p_retailprice, 0.75) as cut from part group by 1)
select p_partkey, p_retailprice >= cut and p_size < 25 as gap from part join c using (p_brand)""")
def top_quantile_gap_flag(t):
    return Q.quantile_gap(t("part"), "p_brand", "p_retailprice", "p_size", 0.75, 25).select("p_partkey", "gap")


@query("top_quantile_gap_global", """
select p_partkey, p_retailprice > (select quantile_cont(p_retailprice, 0.75) from part) and p_size < 25 as gap from part""")
def top_quantile_gap_global(t):
    return Q.quantile_gap(t("part"), None, "p_retailprice", "p_size", 0.75, 25).select("p_partkey", "gap")


MODES = ("click", "view", "purchase")


@query("mode_pivot_delta", """
with f as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events)
select user_id, max(value) filter (where event_type = 'click') as click, max(value) filter (where event_type = 'view') as "view", max(value) filter (where event_type = 'purchase') as purchase,
    max(value) filter (where event_type = 'click') - max(value) filter (where event_type = 'view') as click_minus_view, max(value) filter (where event_type = 'purchase') - max(value) filter (where event_type = 'view') as purchase_minus_view
from f where r = 1 group by user_id""")
def mode_pivot_delta(t):
    return Q.pivot_first(t("events"), "user_id", "event_type", MODES, "value", ["ts", "event_id"], "view")


@query("metric_changes_long", """
with a as (select o_orderpriority as k, avg(o_totalprice) as price, count(*)::double as orders from orders where o_orderstatus = 'O' group by 1),
b as (select o_orderpriority as k, avg(o_totalprice) as price, count(*)::double as orders from orders where o_orderstatus = 'F' group by 1),
u as (select k, 'price' as metric, a.price as before, b.price as after, b.price - a.price as improvement from a join b using (k) union all select k, 'orders', a.orders, b.orders, a.orders - b.orders from a join b using (k))
select k, metric, round(before, 4) as before, round(after, 4) as after, round(improvement, 4) as improvement from u""")
def metric_changes_long(t):
    side = lambda s: t("orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("orders"))
    d = Q.metric_changes(side("O"), side("F"), ["k"], {"price": True, "orders": False})
    return d.select("k", "metric", *(F.round(c, 4).alias(c) for c in ("before", "after", "improvement")))


@query("evenly_spaced_background", """
with k as (select distinct c_custkey from customer), r as (select c_custkey, row_number() over (order by c_custkey) - 1 as position, count(*) over () as n from k)
select c_custkey, position from r where position in (select round_even(i * (n - 1) / 10.0, 0)::bigint from (select max(n) as n from r), range(0, 11) x(i))""")
def evenly_spaced_background(t):
    return Q.evenly_spaced(t("customer"), "c_custkey", 11)


@query("frozen_anti_join", "select o_orderkey, o_custkey from orders o where not exists (select 1 from customer c where c.c_mktsegment = 'BUILDING' and c.c_custkey = o.o_custkey)")
def frozen_anti_join(t):
    from granary.operators.splits import exclude_keys

    frozen = t("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return exclude_keys(t("orders").select("o_orderkey", "o_custkey"), frozen, "o_custkey")


@query("full_outer_indicator", """
select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id is null then 'right_only' when l.doc_id is null then 'left_only' else 'both' end as _merge
from documents d full join labels l on d.doc_id = l.doc_id""")
def full_outer_indicator(t):
    return I.outer_indicator(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id").select("doc_id", "_merge")


@query("one_to_one_join", "select doc_id, n_chars, quality from documents join labels using (doc_id)")
def one_to_one_join(t):
    return I.one_to_one_join(t("documents").select("doc_id", "n_chars"), t("labels").select("doc_id", "quality"), "doc_id")


@query("lookup_by_fallback_keys", """
with d as (select doc_id, source, lang from documents), e as (select doc_id, source, lang, quality from documents join labels using (doc_id) where quality is not null),
g as (select source, lang, min(doc_id) as o, arg_min(quality, doc_id) as quality from e group by 1, 2),
c as (select d.doc_id, e.quality, 0 as key_rank, e.doc_id as o from d join e using (doc_id) union all select d.doc_id, g.quality, 1, g.o from d join g on d.source = g.source and d.lang = g.lang)
select doc_id, quality, key_rank from (select *, row_number() over (partition by doc_id order by key_rank, o) as r from c) where r = 1""")
def lookup_by_fallback_keys(t):
    d = t("documents").select("doc_id", "source", "lang")
    best = d.join(t("labels").select("doc_id", "quality"), "doc_id").where("quality is not null")
    group = best.groupBy("source", "lang").agg(F.min_by(F.struct("doc_id", "quality"), "doc_id").alias("g")).select(F.lit(None).cast("long").alias("doc_id"), "source", "lang", F.col("g.quality").alias("quality"), F.col("g.doc_id").alias("o"))
    own = best.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), "quality", F.col("doc_id").alias("o"))
    return I.lookup_by_keys(d.withColumn("row", F.col("doc_id")), "row", [["doc_id"], ["source", "lang"]], own.unionByName(group), "quality", ["o"]).withColumnRenamed("row", "doc_id")


@query("registry_incremental_new_keys", """
select doc_id, source from documents where doc_id % 2 = 0 union all select doc_id, 'new ' || source from documents where doc_id % 2 <> 0""")
def registry_incremental_new_keys(t):
    """All documents come in; every other one is known already, so both sides grow with the table."""
    """All documents come in; every other one is known already, so both sides grow with the table."""
    d = t("documents").select("doc_id", "source")
    return I.upsert_keep_existing(d.where("doc_id % 2 = 0"), d.withColumn("source", F.concat(F.lit("new "), "source")), "doc_id", ["source"])


@query("conflict_split", """
with b as (select o_orderkey, o_custkey::varchar as id, (o_orderkey % 5)::double + 0.25 as v from orders), c as (select id, count(distinct v) as n from b group by id)
select o_orderkey, case when n > 1 then id || '_' || replace(printf('%.2f', v), '.', 'p') else id end as id from b join c using (id)""")
def conflict_split(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id"), ((F.col("o_orderkey") % 5).cast("double") + 0.25).alias("v"))
    return I.split_conflicts(rows, "id", "v", ["o_orderkey"]).select("o_orderkey", "id")


@query("coalesce_partial_rows", """
with p as (select o_custkey, o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus end as status, case when o_orderkey % 2 = 1 then o_orderpriority end as priority from orders)
select o_custkey, arg_min(status, o_orderkey) filter (where status is not null) as status, arg_min(priority, o_orderkey) filter (where priority is not null) as priority from p group by o_custkey""")
def coalesce_partial_rows(t):
    even = F.col("o_orderkey") % 2 == 0
    p = t("orders").select("o_custkey", "o_orderkey", F.when(even, F.col("o_orderstatus")).alias("status"), F.when(~even, F.col("o_orderpriority")).alias("priority"))
    return I.coalesce_partial(p, "o_custkey", ["o_orderkey"]).select("o_custkey", "status", "priority")


@query("evidence_gate", """
with e as (select doc_id, case when toxic = 1 then 'n_chars' else 'lang' end as field from labels)
select d.doc_id, case when exists (select 1 from e where e.doc_id = d.doc_id and field = 'n_chars') then n_chars end as n_chars, case when exists (select 1 from e where e.doc_id = d.doc_id and field = 'lang') then lang end as lang,
    (n_chars is not null and not exists (select 1 from e where e.doc_id = d.doc_id and field = 'n_chars'))::int + (lang is not null and not exists (select 1 from e where e.doc_id = d.doc_id and field = 'lang'))::int as dropped from documents d""")
def evidence_gate(t):
    e = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "n_chars").otherwise("lang").alias("field"), F.lit("seen").alias("evidence"))
    out = I.evidence_gate(t("documents").select("doc_id", "n_chars", "lang"), e, "doc_id", ["n_chars", "lang"])
    return out.select("doc_id", "n_chars", "lang", F.size("_dropped").alias("dropped"))


@query("unpivot_observations", """
select p_partkey, field, value from (select p_partkey, p_brand, p_type, p_size::varchar as p_size from part) unpivot (value for field in (p_brand, p_type, p_size)) where trim(value) <> ''""")
def unpivot_observations(t):
    from granary.operators.graph import unpivot_observations as unpivot

    return unpivot(t("part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("eligibility_ladder", """
select lang, count(*) as rows, count(*) filter (where n_chars between 200 and 5000) as in_range, count(*) filter (where quality = 1) as good, count(*) filter (where n_chars between 200 and 5000 and quality = 1 and toxic = 0) as eligible
from documents d left join labels l using (doc_id) group by lang""")
def eligibility_ladder(t):
    j = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id", "left")
    size, good = F.col("n_chars").between(200, 5000), F.col("quality") == 1
    return j.groupBy("lang").agg(F.count("*").alias("rows"), *Q.eligibility({"in_range": size, "good": good, "eligible": size & good & (F.col("toxic") == 0)}))


@query("issue_lists", """
select doc_id, concat_ws(',', case when n_chars < 100 then 'short' end, case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end) as issues from documents left join labels using (doc_id) where n_chars < 100 or quality = 0 or toxic = 1""")
def issue_lists(t):
    j = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    found = Q.issues({"short": F.col("n_chars") < 100, "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return j.select("doc_id", F.array_join(found, ",").alias("issues")).where("issues <> ''")


@query("json_cell_explode", """
select event_id, try_cast(props::json->>'k' as bigint) as k from events""")
def json_cell_explode(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
