"""Queries that build domain graphs and evidence from the data tables and reason over them."""

from pyspark.sql import functions as F

from granary.operators import domain, lenses
from granary.operators import graph as G
from granary.plans.base import query

INDEX = [("en", "english", "language"), ("de", "german", "language"), ("src0", "first source", "source")]


def _records(t):
    d = t("documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("record"), F.coalesce("source", F.lit("none")).alias("paper"), i.alias("seq"), F.when(i % 3 == 0, "oxide_perovskite").otherwise("general").alias("_domain_profile"),
        F.when(i % 5 > 0, F.col("lang")).alias("Domain_system_or_subject"), F.when(i % 2 == 0, F.concat(F.lit("m"), i % 7, F.lit("; n/a | m"), i % 3)).alias("Domain_methods"),
        F.when(i % 4 == 0, F.concat(F.lit('["p'), i % 5, F.lit('", "x  y"]'))).alias("Domain_phases"), F.col("source").alias("Domain_origin"),
        F.when(i % 6 == 0, F.concat(F.lit('[{"name": "chars", "value": '), F.coalesce("n_chars", F.lit(0)), F.lit(', "unit": "n"}]'))).alias("Domain_measurements"),
        F.when(i % 12 == 0, F.concat(F.lit("It has "), F.coalesce("n_chars", F.lit(0)), F.lit(" characters."))).alias("_evidence_Domain_measurements"),
        F.when(i % 8 == 0, F.lit("Methods are  stated.")).alias("_evidence_Domain_methods"),
    )


def _domain_graph(t):
    spark = t("documents").sparkSession
    index = spark.createDataFrame(INDEX, "norm string, term string, category string")  # an ontology of three terms
    return domain.domain_subgraph(_records(t), "record", "paper", "seq", F.broadcast(index))


def _id(kind, own):
    return f"'{kind}:' || substr(sha1(lower(trim(regexp_replace({own}, '\\s+', ' ', 'g')))), 1, 20)"


DOMAIN_SQL = rf"""
with i as (select * from (values {', '.join(map(str, INDEX))}) x(norm, term, category)),
r as (
    select doc_id, coalesce(source, 'none') as paper, source, case when doc_id % 3 = 0 then 'oxide_perovskite' else 'general' end as profile, coalesce(case when doc_id % 5 > 0 then nullif(lang, '') end, source, 'none') as system,
        case when doc_id % 2 = 0 then list_distinct(['m' || doc_id % 7, 'm' || doc_id % 3]) else [] end as methods, case when doc_id % 4 = 0 then ['p' || doc_id % 5, 'x y'] else [] end as phases, coalesce(n_chars, 0) as n from documents
), v as (
    select doc_id, paper, profile, 'system' as kind, 'Domain_system_or_subject' as field, system as raw from r
    union all select doc_id, paper, profile, 'method', 'Domain_methods', unnest(methods) from r
    union all select doc_id, paper, profile, 'materialphase', 'Domain_phases', unnest(phases) from r
    union all select doc_id, paper, profile, 'domainattribute', 'Domain_origin', source from r where source <> ''
), w as (
    select v.*, coalesce(term, raw) as name from v left join i on i.norm = lower(raw)
), x as (
    select *, case kind when 'system' then {_id('studiedsystem', "profile || '|' || name")} when 'domainattribute' then {_id('domainattribute', "field || '|' || name")} else kind || ':' || substr(sha1(lower(name)), 1, 20) end as id from w
), m as (
    select doc_id, paper, profile, n, {_id('domainmeasurement', "doc_id || '|chars|' || n || '|n|'")} as id from r where doc_id % 6 = 0
), s as (
    select doc_id, paper, 'Domain_measurements' as field, 'It has ' || n || ' characters.' as said from m where doc_id % 12 = 0
    union all select doc_id, paper, 'Domain_methods', 'Methods are stated.' from r where doc_id % 8 = 0
), e as (
    select *, {_id('domainevidence', "paper || '|' || field || '|' || said")} as id from s
)"""


@query("domain_graph_nodes", DOMAIN_SQL + """, n as (
    select id, case kind when 'system' then 'StudiedSystem' when 'method' then 'Method' when 'materialphase' then 'MaterialPhase' else 'DomainAttribute' end as label, name from x union select id, 'DomainEntity', name from x
    union select id, unnest(['MaterialSystem', 'OxidePerovskite']), name from x where kind = 'system' and profile = 'oxide_perovskite'
    union select id, unnest(['Measurement', 'DomainMeasurement']), 'chars' from m union select id, unnest(['Evidence', 'TextEvidence', 'DomainEvidence']), said from e
)
select id, array_to_string(list_sort(list(distinct label)), ';') as labels, max(name) as name from n group by id""")
def domain_graph_nodes(t):
    nodes, _ = _domain_graph(t)
    return G.merge_nodes(nodes, last_wins=False).select("id", F.array_join("labels", ";").alias("labels"), F.element_at("properties", "name").alias("name"))


@query("domain_graph_edges", DOMAIN_SQL + f""", p as (select distinct paper, {_id('paper', 'paper')} as pid from r), y as (select doc_id, id as sid from x where kind = 'system')
select pid as src, id as dst, 'STUDIES_SYSTEM' as type, count(*) as records from x join p using (paper) where kind = 'system' group by all
union all select sid, id, case kind when 'method' then 'USES_METHOD' when 'materialphase' then 'HAS_PHASE' else 'HAS_DOMAIN_ATTRIBUTE' end, count(*) from x join y using (doc_id) where kind <> 'system' group by all
union all select sid, id, 'HAS_MEASUREMENT', count(*) from m join y using (doc_id) group by all
union all select pid, id, 'HAS_TEXT_EVIDENCE', count(*) from e join p using (paper) group by all
union all select e.id, x.id, 'SUPPORTS_ENTITY_OR_MEASUREMENT', count(*) from e join x on x.doc_id = e.doc_id and x.field = e.field group by all
union all select e.id, m.id, 'SUPPORTS_ENTITY_OR_MEASUREMENT', count(*) from e join m on m.doc_id = e.doc_id and e.field = 'Domain_measurements' group by all""")
def domain_graph_edges(t):
    _, edges = _domain_graph(t)
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("records"))


LINE = r"coalesce(split_part(text, chr(10), 1), '')"


@query("paper_evidence", rf"""
with e as (select coalesce(source, '') as paper, lower(trim(regexp_replace({LINE}, '\s+', ' ', 'g'))) as norm, doc_id, 'line' as field, {LINE} as text from documents),
f as (select paper, norm, min(doc_id) as seq, arg_min(text, doc_id) as text from e where norm <> '' group by paper, norm),
k as (select *, row_number() over (partition by paper order by seq, text) as n from f)
select paper, seq, md5(text) as text_md5 from k where n <= 30""")
def paper_evidence(t):
    lines = t("documents").select(F.coalesce("source", F.lit("")).alias("paper"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("text"), F.lit("line").alias("field"), F.col("doc_id").alias("at"))
    return domain.evidence_candidates(lines, "paper", "text", "field", "at").select("paper", "seq", F.md5("text").alias("text_md5"))


def _parts(t):
    d = t("documents")
    node = F.concat(F.lit("doc:"), F.col("doc_id"))
    has = F.array_compact(F.array(*(F.when(when, kind) for when, kind in (
        (F.col("doc_id") % 2 == 0, F.lit("USES_METHOD")), (F.col("doc_id") % 3 == 0, F.lit("PROCESSED_BY")), (F.col("n_chars") > 500, F.lit("HAS_MEASUREMENT")), (F.col("lang") == "en", F.lit("INCLUDES_ENTITY")), (F.col("doc_id") % 7 == 0, F.lit("HAS_TEXT_EVIDENCE")),
    ))))
    return d.select(node.alias("id")), d.select(node.alias("src"), F.lit("x").alias("dst"), F.explode(has).alias("type"))


PARTS = "select 'doc:' || doc_id as id, lang = 'en' as a, doc_id % 2 = 0 as m, doc_id % 3 = 0 as p, n_chars > 500 as v, doc_id % 7 = 0 as e from documents"


@query("decomposition_steps", f"""
with s as ({PARTS}), l as (select id, list_filter([case when a then '1. entities or composition' end, case when m or p then '2. methods or processing' end, case when v then '4. measurements or domain attributes' end], lambda x: x is not null) as steps from s)
select id, unnest(steps) as step, unnest(range(0, len(steps)))::int as place, len(steps)::bigint as chain from l where len(steps) > 0""")
def decomposition_steps(t):
    """The steps of every document and where they stand on its chain, found again by walking the chain's edges."""
    nodes, edges = _parts(t)
    made, found, _ = lenses.decomposition_lens(nodes, edges, lenses.SYSTEM_STEPS, what="Domain system")
    own = found.where("type = 'HAS_DECOMPOSITION_STEP'").select(F.col("src").alias("of"), F.col("dst").alias("id"))
    walked = lenses.walk_chains(found).select("id", "place")
    placed = own.join(made.select("id", "name"), "id").join(walked, "id", "left").withColumn("place", F.coalesce("place", F.lit(0)))  # a chain of one step has no edge
    sizes = own.groupBy("of").agg(F.count("*").alias("chain"))
    return placed.join(sizes, "of").select(F.col("of").alias("id"), F.col("name").alias("step"), F.col("place").cast("int").alias("place"), "chain")


@query("knowledge_gaps", f"""
select 'claim:' || doc_id as node, 'needs_evidence' as status, 'Need stronger evidence for: ' || substr('claim ' || doc_id || ' of quality ' || coalesce(quality, -1), 1, 140) as gap from labels where quality is distinct from 1
union all select id, 'limited_knowledge', 'Limited extracted knowledge for paper' from ({PARTS}) where not e""")
def knowledge_gaps(t):
    papers, edges = _parts(t)
    claims = t("labels").select(F.concat(F.lit("claim:"), F.col("doc_id")).alias("id"), F.concat(F.lit("claim "), F.col("doc_id"), F.lit(" of quality "), F.coalesce("quality", F.lit(-1))).alias("statement"), F.when(F.col("quality") == 1, "evidence_linked").otherwise("summary_only").alias("support_status"))
    nodes, found, report = lenses.gap_lens(claims, papers, edges)
    gaps = found.where("type = 'HAS_UNCERTAINTY_GAP'").select(F.col("src").alias("node"), F.col("dst").alias("id")).join(nodes.select("id", F.col("name").alias("gap")), "id")
    return report.select("node", "status").join(gaps, "node").select("node", "status", "gap")


@query("reasoning_classes", "select coalesce(case when lang = 'en' then case when doc_id % 2 = 0 then 'finding' else 'Claim' end end, case when lang is null then 'Entity' else lang end) as class, count(*) as n from documents group by 1")
def reasoning_classes(t):
    labels = F.when(F.col("lang") == "en", F.array(F.lit("Claim"), F.col("lang"))).when(F.col("lang").isNotNull(), F.array("lang")).otherwise(F.array().cast("array<string>"))
    nodes, edges = lenses.classification_lens(t("documents").select(F.col("doc_id").cast("string").alias("id"), labels.alias("labels"), F.when(F.col("doc_id") % 2 == 0, "finding").alias("claim_type")))
    return edges.join(nodes, F.col("dst") == nodes.id).groupBy(F.col("name").alias("class")).agg(F.count("*").alias("n"))
