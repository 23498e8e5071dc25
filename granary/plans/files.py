"""Queries that write the data tables as files of other kinds and read them back, and joins and groups over their texts."""

from pyspark.sql import functions as F

from granary.operators import agreement as A
from granary.operators import consolidate as C
from granary.operators import substring
from granary.plans.base import query
from granary.sources import documents as D
from granary.sources import encodings as E
from granary.sources.shared import shared_folder

LATIN = r"^[\x00-\x7F\xA0-\xFF]*$"


@query("csv_of_mixed_encodings", f"""
select doc_id::varchar as doc_id, lang, case when doc_id % 3 <> 1 then source end as source, case when doc_id % 3 = 1 then n_chars::varchar end as n_chars, md5(coalesce(text, '')) as text_md5,
    case when doc_id % 3 = 0 and regexp_full_match(coalesce(text, ''), '{LATIN}') then 'windows-1252' when doc_id % 3 = 1 then 'UTF-16' else 'UTF-8' end as encoding
from documents""")
def csv_of_mixed_encodings(t):
    """documents in files of three encodings and two headers, in one folder, read back as one table."""
    d = t("documents").select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    latin = (F.col("doc_id") % 3 == 0) & F.col("text").rlike(LATIN)
    path = shared_folder(d.sparkSession, "encodings")
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "emptyValue": ""}
    for encoding, df in (("ISO-8859-1", d.where(latin).drop("n_chars")), ("UTF-16", d.where("doc_id % 3 = 1").select("text", "n_chars", "lang", "doc_id")), ("UTF-8", d.where(~latin & (F.col("doc_id") % 3 != 1)).drop("n_chars"))):
        df.withColumn("encoding", F.lit(encoding.replace("ISO-8859-1", "windows-1252"))).write.mode("append").options(**options, encoding=encoding).csv(path)
    rows, _ = E.read_csv_files(d.sparkSession, path, ("UTF-8", "windows-1252"), "*.csv")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "encoding")


def _graph(t):
    d = t("documents")
    properties = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    nodes = d.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.array(F.lit("Document"), F.coalesce("lang", F.lit("none"))).alias("labels"), properties.alias("properties"))
    edges = d.select(
        F.concat(F.lit("in:"), F.col("doc_id")).alias("rel_id"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("src"), F.lit("IN_SOURCE").alias("type"), F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("dst"),
        F.create_map(F.lit("start <&> end"), F.substring(F.coalesce("text", F.lit("")), 1, 30)).alias("properties"),
    )
    return nodes, edges


GRAPH_SQL = r"""
select 'node' as kind, 'doc:' || doc_id as id, {labels} as label, null as src, null as dst, lang, n_chars::varchar as n_chars, null as start from documents
union all
select 'edge', 'in:' || doc_id, 'IN_SOURCE', 'doc:' || doc_id, 'source:' || coalesce(source, ''), null, null, {start} from documents"""


@query("graphml_document", GRAPH_SQL.format(labels="array_to_string(list_sort(['Document', coalesce(lang, 'none')]), ';')", start=r"regexp_replace(substr(coalesce(text, ''), 1, 30), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')"))
def graphml_document(t):
    """A GraphML document of all documents and their sources, read back by an XML parser; each node and edge is a line, and so is read in splits."""
    nodes, edges = _graph(t)
    spark = nodes.sparkSession
    path = shared_folder(spark, "graphml")
    D.write_graphml(nodes, edges, path, "documents")
    found_nodes, found_edges = D.read_graphml(spark, path)
    value = lambda key: F.try_element_at(F.filter("data", lambda x: x["_key"] == key), F.lit(1))["_VALUE"]
    of = lambda key, name: F.element_at(F.from_json(value(key), "map<string,string>"), name)
    none = F.lit(None).cast("string")
    n = found_nodes.select(F.lit("node").alias("kind"), F.col("_id").alias("id"), value("label").alias("label"), none.alias("src"), none.alias("dst"), of("node_properties", "lang").alias("lang"), of("node_properties", "n_chars").alias("n_chars"), none.alias("start"))
    e = found_edges.select(F.lit("edge"), "_id", value("relationship_type"), "_source", "_target", none, none, of("relationship_properties", "start <&> end"))
    return n.unionAll(e)


@query("jsonld_document", GRAPH_SQL.format(labels="'la:' || array_to_string(list_sort(['Document', coalesce(lang, 'none')]), ';')", start="substr(coalesce(text, ''), 1, 30)").replace("select 'node' as kind, 'doc:'", "select 'node' as kind, 'la:doc:'").replace("'in:'", "'la:in:'").replace("'IN_SOURCE', 'doc:'", "'la:IN_SOURCE', 'la:doc:'").replace("'source:'", "'la:source:'"))
def jsonld_document(t):
    """A JSON-LD document of the same graph; each line between its head and foot is an item, and so is read in splits."""
    nodes, edges = _graph(t)
    spark = nodes.sparkSession
    path = shared_folder(spark, "jsonld")
    D.write_jsonld(nodes, edges, path, {"la": "https://example.org/graph/"}, "la:")
    item = F.from_json(F.regexp_replace("value", ",$", ""), "map<string,string>").alias("m")
    lines = spark.read.text(path).where(F.col("value").startswith('{"') & ~F.col("value").startswith('{"@context"')).select(item)
    of = lambda name: F.try_element_at("m", F.lit(name))
    return lines.select(F.when(of("source").isNull(), "node").otherwise("edge").alias("kind"), of("@id").alias("id"), of("@type").alias("label"), of("source").alias("src"), of("target").alias("dst"), of("lang").alias("lang"), of("n_chars").alias("n_chars"), of("start <&> end").alias("start"))


@query("csv_with_united_header", """
select doc_id::varchar as doc_id, case when doc_id % 2 = 0 then lang end as lang, case when doc_id % 3 = 0 then source end as "the source", case when doc_id % 2 = 1 then n_chars::varchar end as n_chars from documents""")
def csv_with_united_header(t):
    """Records with differing keys as one CSV file, whose header unites them, read back."""
    entry = lambda when, k, v: F.when(when, F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
    d = t("documents").select("doc_id", F.map_from_entries(F.array_compact(F.array(entry(F.col("doc_id") % 2 == 0, "lang", F.col("lang")), entry(F.col("doc_id") % 3 == 0, "the source", F.col("source")), entry(F.col("doc_id") % 2 == 1, "n_chars", F.col("n_chars")), entry(F.lit(True), "doc_id", F.col("doc_id"))))).alias("record"))
    path = shared_folder(d.sparkSession, "united")
    D.write_united_csv(d, "record", "doc_id", path)
    return E.read_csv_files(d.sparkSession, path)[0].drop("_file_seq", "_source_file")


@query("benchmark_items_in_documents", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''")
def benchmark_items_in_documents(t):
    return substring.contains_join(t("documents").select("doc_id", "text"), "text", t("benchmark").select("item_id", F.col("text").alias("item")), "item").select("doc_id", "item_id")


@query("page_slugs_in_urls", r"""
with s as (select distinct regexp_extract(url, '([A-Za-z0-9]+)/?$', 1) as slug from pages where regexp_extract(url, '([A-Za-z0-9]+)/?$', 1) <> '')
select page_id, slug from pages join s on contains(url, slug)""")
def page_slugs_in_urls(t):
    """The last words of all urls in all urls: as many needles as pages, by shared grams."""
    slugs = t("pages").select(F.regexp_extract("url", r"([A-Za-z0-9]+)/?$", 1).alias("slug")).where("slug <> ''").distinct()
    return substring.contains_by_grams(t("pages").select("page_id", "url"), "url", slugs, "slug").select("page_id", "slug")


HEAD = "lower(trim(regexp_replace(substr(coalesce(text, ''), 1, 40), '[^A-Za-z]+', ' ', 'g')))"
TAIL = "lower(trim(regexp_replace(right(coalesce(text, ''), 40), '[^A-Za-z]+', ' ', 'g')))"


@query("consolidated_papers", f"""
with recursive k as (
    select doc_id, text, lang, source, n_chars, case when length({HEAD}) > 15 then 'head:' || {HEAD} end as h, case when length({TAIL}) > 15 then 'tail:' || {TAIL} end as t from documents
), r as (
    select *, list_filter([h, t], lambda x: x is not null) as ids from k
), link as (
    select distinct ids[1] as a, unnest(ids) as b from r where len(ids) > 0
), both_ways as (
    select a, b from link union select b, a from link
), reach as (
    select a as id, a as other from both_ways union select reach.id, l.b from reach join both_ways l on l.a = reach.other
), g as (
    select id, min(other) as paper from reach group by id
), p as (
    select r.*, coalesce(g.paper, 'row:' || doc_id) as paper from r left join g on g.id = r.ids[1]
)
select paper, count(*) as raw_record_count, arg_min(lang, doc_id) filter (where lang <> '') as lang, arg_min(n_chars::varchar, doc_id) filter (where n_chars is not null) as n_chars,
    md5(coalesce(arg_min(text, struct_pack(size := -length(text), doc := doc_id)) filter (where length(text) > 0), '')) as longest_md5, array_to_string(list_sort(list(distinct source) filter (where source <> '')), ';') as sources, count(*) filter (where n_chars > 500) as long_records
from p group by paper""")
def consolidated_papers(t):
    """documents as records of papers that are named by how they begin and how they end, so that names chain."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z]+", " ")))
    text = F.coalesce("text", F.lit(""))
    d = t("documents").select("doc_id", "text", "lang", "source", "n_chars", key(F.substring(text, 1, 40)).alias("h"), key(F.right(text, F.lit(40))).alias("e"))
    ids = {"head": F.when(F.length("h") > 15, F.col("h")), "tail": F.when(F.length("e") > 15, F.col("e"))}
    groups = C.paper_groups(d, "doc_id", ids)
    papers = C.consolidate_groups(d.join(groups, "doc_id"), "paper", "doc_id", "doc_id", ["lang", "n_chars"], ["text"], ["source"], {"long_records": F.col("n_chars") > 500}, tidy=False)
    return papers.select("paper", "raw_record_count", "lang", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("longest_md5"), F.array_join("source", ";").alias("sources"), "long_records")


@query("kendall_agreement", """
with v as (select doc_id, n_chars::double as a, length(text) - length(replace(text, ' ', '')) + (doc_id * 7919 % 13) * 9 as b from documents where text is not null and n_chars is not null),
p as (select sign(x.a - y.a) * sign(x.b - y.b) as s, x.a = y.a as ta, x.b = y.b as tb from v x join v y on x.doc_id < y.doc_id)
select (select count(*) from v) as n, count(*) filter (where s > 0) as concordant, count(*) filter (where s < 0) as discordant, count(*) filter (where ta) as tied_a, count(*) filter (where tb) as tied_b, count(*) filter (where ta and tb) as tied_both,
    round(sum(s) / (sqrt(count(*) filter (where not ta)) * sqrt(count(*) filter (where not tb))), 9) as tau from p""")
def kendall_agreement(t):
    d = t("documents").where("text is not null and n_chars is not null")
    v = d.select(F.col("n_chars").cast("double").alias("a"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + (F.col("doc_id") * 7919 % 13) * 9).alias("b"))
    return A.kendall_tau(v, "a", "b").select("n", *(F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "tied_a", "tied_b", "tied_both")), F.round("tau", 9).alias("tau"))


@query("importance_agreement", """
with v as (select source || ':' || coalesce(lang, '') as g, n_chars / 1000.0::double as e, n_chars / 1000.0::double * (1 + (doc_id * 31 % 11 - 5) / 50.0::double) as a from documents where source is not null and n_chars is not null),
m as (select g, avg(abs(a)) as a, avg(abs(e)) as e from v group by g),
r as (select g, a, e, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by e) + (count(*) over (partition by e) - 1) / 2.0 as re from m),
k as (select sum(sign(x.a - y.a) * sign(x.e - y.e)) / (sqrt(count(*) filter (where x.a <> y.a)) * sqrt(count(*) filter (where x.e <> y.e))) as kendall from m x join m y on x.g < y.g),
o as (select count(*) as overlap from (select g from m order by e desc, g limit 20) join (select g from m order by a desc, g limit 20) using (g)),
w as (select corr(a, e) as pearson, avg(abs(a - e)) / avg(abs(e)) as relative_mae from v)
select round(corr(ra, re), 8) as spearman, round(any_value(kendall), 8) as kendall, any_value(overlap) as overlap, round(any_value(pearson), 8) as pearson, round(any_value(relative_mae), 8) as relative_mae,
    corr(ra, re) >= 0.9 and any_value(overlap) >= 15 and any_value(relative_mae) <= 0.25 as passed from r, k, o, w""")
def importance_agreement(t):
    d = t("documents").where("source is not null and n_chars is not null")
    exact = F.col("n_chars") / 1000.0
    v = d.select(F.concat("source", F.lit(":"), F.coalesce("lang", F.lit(""))).alias("g"), exact.alias("e"), (exact * (1 + (F.col("doc_id") * 31 % 11 - 5) / 50.0)).alias("a"))
    found = A.importance_agreement(v, "g", "a", "e")
    return found.select(*(F.round(c, 8).alias(c) for c in ("spearman", "kendall", "pearson", "relative_mae")), "overlap", "passed")
