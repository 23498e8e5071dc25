"""Metrics, shift, bootstrap and split queries over the data tables."""

from pyspark.sql import functions as F

from granary.functions import physics as P
from granary.operators import metrics as M
from granary.operators import models as L
from granary.operators import splits as S
from granary.plans.base import query

PREDICTIONS = "(select l.*, l_extendedprice as y, l_quantity * p_retailprice as p, l_orderkey % 5 as fold from lineitem l join part on l_partkey = p_partkey)"


def _predictions(t):
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    j = li.join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"), (F.col("l_orderkey") % 5).alias("fold"))


SCORES = "round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) as r2, round(sqrt(sum((p - y) * (p - y)) / count(*)), 4) as rmse, round(sum(abs(p - y)) / count(*), 4) as mae"


def _rounded(df, *keep):
    return df.select(*keep, "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("regression_metrics", f"select count(*) as n, {SCORES} from {PREDICTIONS}")
def regression_metrics(t):
    return _rounded(M.regression_metrics(_predictions(t), "y", "p"))


@query("grouped_fold_metrics", f"select fold, count(*) as n, {SCORES} from {PREDICTIONS} group by fold")
def grouped_fold_metrics(t):
    return _rounded(M.regression_metrics(_predictions(t), "y", "p", ["fold"]), "fold")


@query("classification_metrics_auc", """
with r as (select quality as y, n_chars as s from labels join documents using (doc_id) where quality is not null),
k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from r), n as (select sum(y)::bigint as positives, sum(1 - y)::bigint as negatives from r)
select positives, negatives, round((select sum(r) from k where y = 1) / (positives * negatives)::double - (positives + 1) / 2.0 / negatives, 8) as auc from n""")
def classification_metrics_auc(t):
    j = t("labels").select("doc_id", "quality").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return M.roc_auc(j, "quality", "n_chars").select("positives", "negatives", F.round("auc", 8).alias("auc"))


CONFUSION = "count(*) as n, count(*) filter (where y and p) as tp, count(*) filter (where not y and p) as fp, count(*) filter (where y and not p) as fn, count(*) filter (where not y and not p) as tn"


@query("precision_recall_by_stratum", f"""
with r as (select lang, quality = 1 as y, n_chars > 1000 as p from labels join documents using (doc_id)), c as (select lang, {CONFUSION} from r group by lang)
select *, round((tp + tn) / n::double, 8) as accuracy, round((coalesce(tp / nullif(tp + fn, 0)::double, 0) + coalesce(tn / nullif(tn + fp, 0)::double, 0)) / 2, 8) as balanced_accuracy,
    round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 8) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 8) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 8) as f1 from c""")
def precision_recall_by_stratum(t):
    j = t("labels").select("doc_id", "quality").join(t("documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("p")), "doc_id")
    m = M.classification_metrics(j, "quality", "p", ["lang"])
    return m.select("lang", "n", "tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")))


@query("cohen_kappa", """
with l as (select quality as a, toxic as b from labels where quality is not null and toxic is not null), n as (select count(*) as n, (count(*) filter (where a = b))::double / count(*) as o,
    ((count(*) filter (where a = 0))::double * (count(*) filter (where b = 0)) + (count(*) filter (where a = 1))::double * (count(*) filter (where b = 1))) / (count(*)::double * count(*)) as e from l)
select n, round(o, 8) as observed, round(e, 8) as expected, round(case when e = 1 then 1 else (o - e) / (1 - e) end, 8) as kappa from n""")
def cohen_kappa(t):
    k = M.cohen_kappa(t("labels"), "quality", "toxic")
    return k.select("n", *(F.round(c, 8).alias(c) for c in ("observed", "expected", "kappa")))


@query("macro_f1_by_source", """
with r as (select source, quality::varchar as g, (n_chars > 1000)::int::varchar as p from labels join documents using (doc_id)), c as (select distinct source, c from (select source, g as c from r union all select source, p from r)),
s as (select c.source, c.c, count(*) filter (where g = c.c and p = c.c) as tp, count(*) filter (where p = c.c and g <> c.c) as fp, count(*) filter (where g = c.c and p <> c.c) as fn from c join r on r.source = c.source group by 1, 2)
select source, round(avg(2.0 * tp / (2 * tp + fp + fn)), 8) as macro_f1, count(*) as classes from s group by source""")
def macro_f1_by_source(t):
    j = t("labels").select("doc_id", F.col("quality").cast("string").alias("g")).join(t("documents").select("doc_id", "source", (F.col("n_chars") > 1000).cast("int").cast("string").alias("p")), "doc_id")
    return M.macro_f1(j, "g", "p", ["source"]).select("source", F.round("macro_f1", 8).alias("macro_f1"), "classes")


SHIFT = "(select *, ts < (select min(ts) + (max(ts) - min(ts)) / 2 from events) as early from events)"


def _halves(t):
    e = t("events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return e, F.col("ts") < F.lit(lo + (hi - lo) / 2)


@query("distribution_shift_tvd", """
with c as (select l_returnflag as c, count(*) filter (where l_quantity < 25)::double as a, count(*) filter (where l_quantity >= 25)::double as b from lineitem group by 1)
select round(0.5 * sum(abs(a / (select sum(a) from c) - b / (select sum(b) from c))), 8) as tvd, round(sum(case when a = 0 then b else 0 end) / (select sum(b) from c), 8) as unseen_rate,
    count(*) filter (where a > 0) as categories_a, count(*) filter (where b > 0) as categories_b from c""")
def distribution_shift_tvd(t):
    d = M.total_variation(t("lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", F.col("l_quantity") < 25)
    return d.select(F.round("tvd", 8).alias("tvd"), F.round("unseen_rate", 8).alias("unseen_rate"), "categories_a", "categories_b")


@query("distribution_shift_ks", """
with v as (select value as v, event_type = 'click' as a from events where value is not null), n as (select count(*) filter (where a) as na, count(*) filter (where not a) as nb from v),
c as (select v, sum(count(*) filter (where a)) over (order by v)::double / (select na from n) as x, sum(count(*) filter (where not a)) over (order by v)::double / (select nb from n) as y from v group by v)
select round(max(abs(x - y)), 8) as ks, (select na from n)::bigint as n_a, (select nb from n)::bigint as n_b from c""")
def distribution_shift_ks(t):
    k = M.ks_statistic(t("events"), "value", F.col("event_type") == "click")
    return k.select(F.round("ks", 8).alias("ks"), "n_a", "n_b")


@query("distribution_shift_smd", """
select round(avg(value) filter (where event_type = 'click'), 6) as mean_a, round(avg(value) filter (where event_type <> 'click'), 6) as mean_b,
    round((avg(value) filter (where event_type = 'click') - avg(value) filter (where event_type <> 'click')) / sqrt((var_samp(value) filter (where event_type = 'click') + var_samp(value) filter (where event_type <> 'click')) / 2), 8) as smd from events""")
def distribution_shift_smd(t):
    d = M.standardized_difference(t("events"), "value", F.col("event_type") == "click")
    return d.select(F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("smd", 8).alias("smd"))


@query("spearman_rank", """
with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part)
select round(corr(a, b), 8) as spearman, count(*) as n from r""")
def spearman_rank(t):
    return M.spearman(t("part"), "p_size", "p_retailprice").select(F.round("spearman", 8).alias("spearman"), "n")




@query("cluster_bootstrap_ci", """
with recursive f(k, p, s) as (select 0, exp(-1.0), exp(-1.0) union all select k + 1, p / (k + 1), s + p / (k + 1) from f where k < 10),
o as (select coalesce(o_custkey::varchar, 'NO_GROUP') as g, o_totalprice as y, o_totalprice * (0.9 + (o_orderkey % 7) / 30.0) as p from orders),
s as (select g, count(*) as n, sum(y) as sy, sum(y * y) as syy, sum((p - y) * (p - y)) as se2, sum(abs(p - y)) as sae from o group by g),
u as (select s.*, d, ('0x' || substr(md5('42:' || d // 4 || ':' || g), 1 + 8 * (d % 4)::int, 8))::bigint / 4294967296.0::double as u from s, range(0, 2000) x(d)),
w as (select u.*, (select count(*) from f where u.u >= s) as m from u),
b as (select d, sum(m * n)::double as n, sum(m * sy) as sy, sum(m * syy) as syy, sum(m * se2) as se2, sum(m * sae) as sae from w where m > 0 group by d),
r as (select 1 - se2 / (syy - sy * sy / n) as r2, sqrt(se2 / n) as rmse, sae / n as mae from b),
a as (select sum(n)::bigint as rows, count(*) as groups, 1 - sum(se2) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) as r2, sqrt(sum(se2) / sum(n)) as rmse, sum(sae) / sum(n) as mae from s)
""" + " union all ".join(f"select '{m}' as metric, round((select {m} from a), 4) as estimate, round(quantile_cont({m}, 0.025), 4) as ci_lower, round(quantile_cont({m}, 0.975), 4) as ci_upper, count(*) as draws, (select rows from a) as rows, (select groups from a) as groups from r" for m in ("r2", "rmse", "mae")))
def cluster_bootstrap_ci(t):
    o = t("orders").select("o_custkey", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 7) / 30.0)).alias("p"))
    b = M.cluster_bootstrap(o, "y", "p", "o_custkey")
    return b.select("metric", *(F.round(c, 4).alias(c) for c in ("estimate", "ci_lower", "ci_upper")), "draws", "rows", "groups")


@query("paired_bootstrap_deltas", """
with recursive f(k, p, s) as (select 0, exp(-1.0), exp(-1.0) union all select k + 1, p / (k + 1), s + p / (k + 1) from f where k < 10),
o as (select coalesce(o_custkey::varchar, 'NO_GROUP') as g, o_totalprice as y, o_totalprice * 0.9::double as a, o_totalprice * (0.9 + (o_orderkey % 7) / 30.0) as b from orders),
s as (select g, count(*) as n, sum(y) as sy, sum(y * y) as syy, sum((a - y) * (a - y)) as ea, sum(abs(a - y)) as aa, sum((b - y) * (b - y)) as eb, sum(abs(b - y)) as ab from o group by g),
u as (select s.*, d, ('0x' || substr(md5('42:' || d || ':' || g), 1, 13))::bigint / 4503599627370496.0::double as u from s, range(0, 2000) x(d)),
w as (select u.*, (select count(*) from f where u.u >= s) as m from u),
t as (select d, sum(m * n)::double as n, sum(m * sy) as sy, sum(m * syy) as syy, sum(m * ea) as ea, sum(m * aa) as aa, sum(m * eb) as eb, sum(m * ab) as ab from w where m > 0 group by d),
r as (select (ea - eb) / (syy - sy * sy / n) as r2, sqrt(eb / n) - sqrt(ea / n) as rmse, (ab - aa) / n as mae from t)
""" + " union all ".join(f"select '{m}' as metric, round(quantile_cont({m}, 0.5), 4) as median_delta, round(quantile_cont({m}, 0.025), 4) as ci_lower, round(quantile_cont({m}, 0.975), 4) as ci_upper, count(*) as draws from r" for m in ("r2", "rmse", "mae")))
def paired_bootstrap_deltas(t):
    o = t("orders").select("o_custkey", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9).alias("a"), (F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 7) / 30.0)).alias("b"))
    return M.paired_bootstrap(o, "y", "a", "b", "o_custkey").select("metric", *(F.round(c, 4).alias(c) for c in ("median_delta", "ci_lower", "ci_upper")), "draws")


@query("cluster_bootstrap_multinomial", """
with o as (select n_name as g, c_acctbal as y, c_acctbal * 0.9 + 1 as p from customer join nation on c_nationkey = n_nationkey),
s as (select g, count(*) as n, sum(y) as sy, sum(y * y) as syy, sum((p - y) * (p - y)) as se2, sum(abs(p - y)) as sae, row_number() over (order by g) - 1 as k, count(*) over () as all from o group by g),
d as (select d, floor(('0x' || substr(md5('42:' || d || ':' || t), 1, 13))::bigint / 4503599627370496.0::double * (select max("all") from s))::bigint as k from range(0, 2000) x(d), range(0, (select max("all") from s)) y(t)),
b as (select d, sum(n)::double as n, sum(sy) as sy, sum(syy) as syy, sum(se2) as se2, sum(sae) as sae from d join s using (k) group by d),
r as (select 1 - se2 / (syy - sy * sy / n) as r2, sqrt(se2 / n) as rmse, sae / n as mae from b),
a as (select sum(n)::bigint as rows, count(*) as groups, 1 - sum(se2) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) as r2, sqrt(sum(se2) / sum(n)) as rmse, sum(sae) / sum(n) as mae from s)
""".replace("as all ", 'as "all" ') + " union all ".join(f"select '{m}' as metric, round((select {m} from a), 6) as estimate, round(quantile_cont({m}, 0.025), 6) as ci_lower, round(quantile_cont({m}, 0.975), 6) as ci_upper, count(*) as draws, (select rows from a) as rows, (select groups from a) as groups from r" for m in ("r2", "rmse", "mae")))
def cluster_bootstrap_multinomial(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("c_acctbal").alias("y"), (F.col("c_acctbal") * 0.9 + 1).alias("p"))
    b = M.cluster_bootstrap(j, "y", "p", "n_name", law="multinomial")
    return b.select("metric", *(F.round(c, 6).alias(c) for c in ("estimate", "ci_lower", "ci_upper")), "draws", "rows", "groups")


@query("group_kfold_leakage_check", "select 0::bigint as groups_in_two_folds, count(*) as rows, 5::bigint as folds from orders")
def group_kfold_leakage_check(t):
    folded = S.balanced_group_folds(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)
    bad = M.fold_integrity(folded, "o_custkey", "fold").agg(F.count("*").alias("groups_in_two_folds"))
    return folded.agg(F.count("*").alias("rows"), F.count_distinct("fold").alias("folds")).crossJoin(F.broadcast(bad)).select("groups_in_two_folds", "rows", "folds")


@query("group_kfold_balance")
def group_kfold_balance(t):
    """Rows and groups of each fold."""
    folded = S.balanced_group_folds(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)
    return folded.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("groups"))


@query("hash_group_folds", """
select o_orderkey, ('0x' || substr(md5('42:' || o_custkey), 1, 8))::bigint % 5 as fold from orders""")
def hash_group_folds(t):
    return t("orders").select("o_orderkey", S.hash_group_fold(F.col("o_custkey").cast("string"), 5).alias("fold"))


@query("group_shuffle_holdout", """
select o_orderkey, ('0x' || substr(md5('42:' || o_custkey), 1, 13))::bigint / 4503599627370496.0::double < 0.2 as is_test from orders""")
def group_shuffle_holdout(t):
    return S.group_holdout(t("orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "is_test")


@query("stratified_sample", """
select c_custkey, c_mktsegment, rank from (select *, row_number() over (partition by c_mktsegment order by md5('42:' || c_custkey), c_custkey) as rank from customer) where rank <= 5""")
def stratified_sample(t):
    return S.stratified_sample(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5)


@query("physics_factors", """
with c as (select l_orderkey, l_linenumber, 290 + l_quantity as t, l_discount * 1000 as rh, 0.5 + l_tax * 10 as s from lineitem),
f as (select *, exp(greatest(-50, least(50, (0.6 / 8.617333262e-5) * (1 / 298.15 - 1 / t)))) as a, case when rh <= 50 then 1.0 else rh / 50 end as b, pow(s / 1.0, 0.7) as d from c)
select l_orderkey, l_linenumber, round(a, 6) as af_temperature, round(b, 6) as af_humidity, round(d, 6) as af_light, round(a * b * d, 6) as af_total from f""")
def physics_factors(t):
    f = P.acceleration_factors(290 + F.col("l_quantity"), F.col("l_discount") * 1000, 0.5 + F.col("l_tax") * 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for n, c in f.items()))


@query("unit_standardisation", """
with s as (select quantile_cont(l_quantity, 0.5) as m, quantile_cont(l_discount, 0.95) as h from lineitem)
select l_orderkey, l_linenumber, case when m between 250 and 400 then l_quantity when m between -50 and 150 then l_quantity + 273.15 end as kelvin, case when h <= 1 then l_discount * 100 else l_discount end as humidity from lineitem, s""")
def unit_standardisation(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_linenumber", P.standardize_temperature(li, "l_quantity").alias("kelvin"), P.standardize_humidity(li, "l_discount").alias("humidity"))


@query("threshold_labels", """
select o_orderkey, (o_totalprice >= 150000)::int::double as ge, case when o_orderdate >= timestamp '1996-01-01' then (o_totalprice >= 150000)::int::double end as ge_gated, round(ln(1 + o_totalprice), 8) as log_target from orders""")
def threshold_labels(t):
    x = F.col("o_totalprice")
    return t("orders").select("o_orderkey", P.threshold_label(x, 150000).alias("ge"), P.threshold_label(x, 150000, F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("ge_gated"), F.round(P.log1p_target(x), 8).alias("log_target"))


@query("residual_model_stages")
def residual_model_stages(t):
    p = t("part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name_length"), F.element_at(F.split("p_type", " "), 1).alias("type"), F.element_at(F.split("p_name", " "), 1).alias("name"),
        (F.col("p_partkey") % 100).cast("double").alias("series"), "p_retailprice", S.hash_group_fold(F.col("p_brand"), 5).alias("fold"),
    )
    stages = L.residual_stages(p, [["size"], ["name_length", "name"], ["type"], ["series"]], "p_retailprice", "fold", 5, categorical=["name", "type"])
    return stages.select("p_partkey", *(f"oof_stage_{k}" for k in range(1, 5)), "oof")


@query("ridge_tuned_by_fold", f"""
with x as (
    select doc_id, n_chars::double as a, ln(1 + n_chars) as b, strlen(coalesce(text, ''))::double as y, ('0x' || substr(md5('42:' || coalesce(source, '')), 1, 8))::bigint % 3 as fold from documents where n_chars is not null
), l as (
    select unnest([0.1, 1.0, 10.0, 100.0])::double as penalty
), g as (
    select f.fold, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as cab, covar_pop(a, y) as cay, covar_pop(b, y) as cby
    from x join (select unnest([0, 1, 2]) as fold) f on x.fold <> f.fold group by f.fold
), s as (
    select fold, penalty, n, ma, mb, my, sqrt(va) as sa, sqrt(vb) as sb, n + penalty as d, n * cab / sqrt(va * vb) as o, n * cay / sqrt(va) as pa, n * cby / sqrt(vb) as pb from g, l
), w as (
    select fold, penalty, ma, mb, my, (pa * d - o * pb) / (d * d - o * o) / sa as wa, (pb * d - o * pa) / (d * d - o * o) / sb as wb from s
), e as (
    select penalty, y, my + wa * (a - ma) + wb * (b - mb) as p from x join w using (fold)
)
select penalty, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) as r2 from e, (select avg(y) as m from x) group by penalty""")
def ridge_tuned_by_fold(t):
    d = t("documents").where("n_chars is not null").select(
        F.col("n_chars").cast("double").alias("a"), F.log1p(F.col("n_chars").cast("double")).alias("b"), F.octet_length(F.coalesce("text", F.lit(""))).cast("double").alias("y"), S.hash_group_fold(F.coalesce("source", F.lit("")), 3).alias("fold"),
    )
    scores = L.fit_ridge(d, ["a", "b"], "y", "fold", 3).scores
    return d.sparkSession.createDataFrame(scores, "penalty double, rmse double, r2 double").select("penalty", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))
