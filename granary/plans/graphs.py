"""Property-graph queries: customers, orders, parts and suppliers as nodes; what joins them as edges."""

from pyspark.sql import functions as F

from granary.functions.normalize import stable_id
from granary.operators import graph as G
from granary.plans.base import query


def _props(*columns):
    return F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(c).cast("string")) for c in columns)))


def _candidates(t):
    customers = t("customer").select(stable_id("customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), _props("c_name", "c_mktsegment").alias("properties"), F.col("c_custkey").alias("seq"))
    orders = t("orders").select(stable_id("order", "o_orderkey").alias("id"), F.lit("Order").alias("label"), _props("o_orderstatus", "o_orderpriority").alias("properties"), F.col("o_orderkey").alias("seq"))
    seen = t("orders").select(stable_id("customer", "o_custkey").alias("id"), F.lit("Buyer").alias("label"), _props("o_orderpriority").alias("properties"), F.col("o_orderkey").alias("seq"))
    return customers.union(orders).union(seen)


def _edges(t):
    o = t("orders").select(stable_id("customer", "o_custkey").alias("src"), stable_id("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), _props("o_orderstatus").alias("properties"), F.col("o_orderkey").alias("seq"))
    li = t("lineitem").select(stable_id("order", "l_orderkey").alias("src"), stable_id("part", "l_partkey").alias("dst"), F.lit("CONTAINS").alias("type"), _props("l_returnflag").alias("properties"), F.col("l_linenumber").cast("long").alias("seq"))
    return o.union(li)


ID = "'{0}:' || substr(sha1({1}::varchar), 1, 20)"


@query("graph_nodes", f"""
with b as (select {ID.format('customer', 'o_custkey')} as id, arg_max(o_orderpriority, o_orderkey) as p from orders group by 1),
c as (select {ID.format('customer', 'c_custkey')} as id, c_name, c_mktsegment from customer),
n as (select coalesce(b.id, c.id) as id, concat_ws(';', case when b.id is not null then 'Buyer' end, case when c.id is not null then 'Customer' end) as labels,
    concat_ws(',', 'c_mktsegment=' || c_mktsegment, 'c_name=' || c_name, 'o_orderpriority=' || p) as properties from b full join c on b.id = c.id)
select * from n union all select {ID.format('order', 'o_orderkey')}, 'Order', 'o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus from orders""")
def graph_nodes(t):
    nodes = G.merge_nodes(_candidates(t))
    entries = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return nodes.select("id", F.array_join("labels", ";").alias("labels"), F.array_join(entries, ",").alias("properties"))


@query("graph_nodes_first_wins", f"""
select {ID.format('customer', 'o_custkey')} as id, arg_min(o_orderpriority, o_orderkey) as first_priority from orders group by 1""")
def graph_nodes_first_wins(t):
    seen = t("orders").select(stable_id("customer", "o_custkey").alias("id"), F.lit("Buyer").alias("label"), _props("o_orderpriority").alias("properties"), F.col("o_orderkey").alias("seq"))
    return G.merge_nodes(seen, last_wins=False).select("id", F.col("properties.o_orderpriority").alias("first_priority"))


@query("graph_edges", f"""
select distinct {ID.format('customer', 'o_custkey')} as src, {ID.format('order', 'o_orderkey')} as dst, 'PLACED' as type, o_orderstatus as property from orders
union all select distinct {ID.format('order', 'l_orderkey')}, {ID.format('part', 'l_partkey')}, 'CONTAINS', l_returnflag from lineitem""")
def graph_edges(t):
    return G.merge_edges(_edges(t)).select("src", "dst", "type", F.get(F.map_values("properties"), F.lit(0)).alias("property"))


@query("graph_dangling", f"""
with n as (select {ID.format('customer', 'c_custkey')} as id from customer union select {ID.format('order', 'o_orderkey')} from orders union select {ID.format('customer', 'o_custkey')} from orders),
e as (select {ID.format('customer', 'o_custkey')} as src, {ID.format('order', 'o_orderkey')} as dst from orders union all select {ID.format('order', 'l_orderkey')}, {ID.format('part', 'l_partkey')} from lineitem)
select 'src' as "end", count(*) as edges from e where src not in (select id from n) having count(*) > 0
union all select 'dst', count(*) from e where dst not in (select id from n) having count(*) > 0""")
def graph_dangling(t):
    """All edges against all nodes; parts are no nodes, so every CONTAINS edge dangles."""
    edges = _edges(t).select(F.concat_ws("|", "type", "src", "dst", "seq").alias("rel_id"), "src", "dst")
    return G.dangling(_candidates(t).select("id"), edges).groupBy("end").agg(F.count("*").alias("edges"))


@query("graph_missing_properties", f"""
select {ID.format('customer', 'c_custkey')} as id, case when c_acctbal < 0 then 'phone,rating' else 'phone' end as missing from customer""")
def graph_missing_properties(t):
    rating = F.when(F.col("c_acctbal") >= 0, F.lit("rating"))
    props = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("c_name").alias("k"), F.col("c_name").alias("v")), F.when(rating.isNotNull(), F.struct(rating.alias("k"), F.col("c_acctbal").cast("string").alias("v"))))))
    nodes = t("customer").select(stable_id("customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), props.alias("properties"))
    found = G.missing_properties(nodes, "id", F.col("label"), {"Customer": ["c_name", "phone", "rating"]})
    return found.select("id", F.array_join("missing", ",").alias("missing"))


@query("graph_counts", """
select 'node:Buyer' as kind, count(distinct o_custkey) as count from orders union all select 'node:Customer', count(*) from customer union all select 'node:Order', count(*) from orders
union all select 'edge:PLACED', count(*) from orders union all select 'edge:CONTAINS', count(*) from (select distinct l_orderkey, l_partkey, l_returnflag from lineitem)""")
def graph_counts(t):
    nodes = G.label_counts(G.merge_nodes(_candidates(t))).select(F.concat(F.lit("node:"), "node_type").alias("kind"), "count")
    return nodes.union(G.type_counts(G.merge_edges(_edges(t))).select(F.concat(F.lit("edge:"), "relationship_type"), "count"))


@query("schema_flows", """
select c_mktsegment as source_label, 'PLACED' as type, o_orderstatus as target_label, count(*) as count from orders join customer on o_custkey = c_custkey group by 1, 3""")
def schema_flows(t):
    nodes = t("customer").select(stable_id("customer", "c_custkey").alias("id"), F.array("c_mktsegment").alias("labels")).union(t("orders").select(stable_id("order", "o_orderkey").alias("id"), F.array("o_orderstatus").alias("labels")))
    edges = t("orders").select(stable_id("customer", "o_custkey").alias("src"), stable_id("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"))
    return G.schema_flows(nodes, edges)


@query("relationship_patterns", """
select n_name as subject, l_returnflag as relation, l_linestatus as object, count(distinct l_orderkey) as papers, count(distinct l_orderkey || '-' || l_linenumber) as claims, arg_min(l_orderkey || '-' || l_linenumber, l_orderkey * 100 + l_linenumber) as first_claim
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3""")
def relationship_patterns(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    j = li.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = j.select(F.col("n_name").alias("subject"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("object"), "l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return G.relationship_patterns(s, "l_orderkey", "seq")


@query("opposition_tension", """
select user_id as src, floor(value / 10)::bigint as dst, array_to_string(list_sort(list(distinct event_type)), ',') as types, count(*) as count from events group by 1, 2
having list_contains(list(distinct event_type), 'click') and list_contains(list(distinct event_type), 'view')""")
def opposition_tension(t):
    edges = t("events").select(F.col("user_id").alias("src"), F.floor(F.col("value") / 10).alias("dst"), F.col("event_type").alias("type"))
    return G.opposition_tension(edges, {"click": "view", "view": "click"}).withColumn("types", F.array_join("types", ","))


@query("layer_sequence_links", """
select * from (select conv_id, turn as src, lead(turn) over (partition by conv_id order by turn) as dst, row_number() over (partition by conv_id order by turn) as step from conversations) where dst is not null""")
def layer_sequence_links(t):
    return G.sequence_links(t("conversations"), "conv_id", "turn", "turn")


@query("knowledge_cards", """
select s_suppkey, count(*) as claims, sum(length(coalesce(n_name, '')))::bigint as name_length from supplier left join nation on s_nationkey = n_nationkey group by 1""")
def knowledge_cards(t):
    papers = t("supplier").select("s_suppkey", F.col("s_name").alias("title"))
    claims = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_nationkey").alias("claim"), F.col("n_name").alias("statement"))
    cards = G.knowledge_cards(papers, claims, "s_suppkey", "claim")
    parsed = cards.select("s_suppkey", F.from_json("card", "s_suppkey long, title string, claims array<struct<claim:int,statement:string>>").alias("c"))
    return parsed.select("s_suppkey", F.size("c.claims").cast("long").alias("claims"), F.aggregate("c.claims", F.lit(0).cast("long"), lambda a, x: a + F.length(x.statement)).alias("name_length"))


@query("ontology_synonyms", """
select lower(trim(p_name)) as norm, arg_min(p_brand, p_partkey) as term from part group by 1""")
def ontology_synonyms(t):
    return G.ontology_index(t("part").select(F.col("p_brand").alias("term"), F.col("p_name").alias("synonym"), "p_partkey"), "p_partkey")


@query("graph_checks", f"""
with s as (select distinct {ID.format('supplier', 's_suppkey')} as id from supplier)
select 'dangling_relationships' as "check", count(distinct l_orderkey || '-' || l_linenumber) as violations from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)
union all select 'required_node_property_violations', (select count(*) from supplier where s_acctbal < 0)
union all select 'required_relationship_property_violations', (select count(*) from lineitem where l_linenumber > 2)
union all select 'unsupported_claims', (select count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'A'))
union all select 'unguarded_directional_relations', (select count(*) from lineitem where l_returnflag = 'R' and l_linenumber > 2)""")
def graph_checks(t):
    """Suppliers are claims, parts of some size other nodes; lines are edges, of which those returned support and those refused are directional."""
    name = F.when(F.col("s_acctbal") >= 0, F.col("s_name")).otherwise("")
    suppliers = t("supplier").select(stable_id("supplier", "s_suppkey").alias("id"), F.lit("ScientificClaim").alias("label"), F.create_map(F.lit("name"), name).alias("properties"))
    parts = t("part").where("p_size > 10").select(stable_id("part", "p_partkey").alias("id"), F.lit("Part").alias("label"), F.create_map(F.lit("name"), "p_name").alias("properties"))
    kind = F.when(F.col("l_returnflag") == "A", "SUPPORTED_BY").when(F.col("l_returnflag") == "R", "DIRECTIONAL_RELATION").otherwise("OTHER")
    guard = F.when(F.col("l_linenumber") <= 2, F.col("l_linestatus"))
    edges = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("rel_id"), stable_id("supplier", "l_suppkey").alias("src"), stable_id("part", "l_partkey").alias("dst"), kind.alias("type"), F.create_map(F.lit("status"), guard).alias("properties"))
    every = {"SUPPORTED_BY": ["status"], "DIRECTIONAL_RELATION": ["status"], "OTHER": ["status"]}
    return G.graph_checks(suppliers.union(parts), edges, {"ScientificClaim": ["name"], "Part": ["name"]}, every, guards=["status"])


@query("claim_support", """
with l as (select l_suppkey, l_returnflag as kind, l_linenumber as shared, l_discount * 10 as score from lineitem), r as (select *, shared >= 2 and score >= case kind when 'A' then 0.35 when 'R' then 0.75 else 100 end as ok from l)
select l_suppkey, count(*) filter (where ok and kind = 'A') as "A_support_count", count(*) filter (where ok and kind = 'R') as "R_support_count", count(*) filter (where ok) as evidence_support_count, case when count(*) filter (where ok) > 0 then 'evidence_linked' else 'summary_only' end as support_status from r group by 1""")
def claim_support(t):
    links = t("lineitem").select("l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("shared"), (F.col("l_discount") * 10).alias("score"))
    return G.claim_support(links, "l_suppkey", "kind", {"A": 0.35, "R": 0.75})


@query("evidence_lens", """
select 'evidence' as src, l_suppkey as dst, case when count(*) filter (where l_returnflag = 'A' and l_linenumber >= 2 and l_discount >= 0.09) > 0 then 'POLICY_PRIORITIZES_EVIDENCE_LINKED_CLAIM' else 'POLICY_FLAGS_WEAK_EVIDENCE' end as type from lineitem group by l_suppkey""")
def evidence_lens(t):
    links = t("lineitem").select("l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("shared"), F.col("l_discount").alias("score"))
    return G.evidence_lens(G.claim_support(links, "l_suppkey", "kind", {"A": 0.09}), "evidence", "l_suppkey")


def _events(t):
    return t("events").select(F.col("user_id").alias("src"), F.floor(F.col("value") / 10).alias("dst"), F.col("event_type").alias("type"))


@query("constraint_warnings", """
with f as (select c_custkey as id, coalesce(bool_or(event_type in ('click', 'view')), false) as seen, coalesce(bool_or(event_type = 'purchase'), false) as bought from customer left join events on user_id = c_custkey group by 1)
select id, concat_ws(',', case when not seen then 'seen' end, case when not bought then 'bought' end) as missing from f where not seen or not bought""")
def constraint_warnings(t):
    w = G.constraint_warnings(t("customer").select(F.col("c_custkey").alias("id")), _events(t), {"seen": ["click", "view"], "bought": ["purchase"]})
    return w.select("id", F.array_join("missing", ",").alias("missing"))


@query("supported_nodes", """
with e as (select user_id as src, floor(value / 10)::bigint as dst, event_type as type from events), s as (select distinct dst from e where type = 'purchase' and dst is not null)
select dst as id from s union select src from e where type <> 'purchase' and dst in (select dst from s)""")
def supported_nodes(t):
    return G.supported_nodes(_events(t), "purchase")


@query("abstraction_lens", """
select 'node' as kind, label as a, count(*) as n from (values ('goods'), ('people')) x(label) group by 2 union all select 'edge', case when p_size > 25 then 'goods' else 'people' end, count(*) from part where p_size <> 50 group by 2""")
def abstraction_lens(t):
    label = F.when(F.col("p_size") == 50, "Other").when(F.col("p_size") > 25, "Part").otherwise("Customer")
    nodes, edges = G.abstraction_lens(t("part").select(F.col("p_partkey").alias("id"), label.alias("label")), {"Part": "goods", "Customer": "people"}, "p")
    names = nodes.select(F.col("id").alias("dst"), F.col("properties.name").alias("a"))
    return nodes.select(F.lit("node").alias("kind"), F.col("properties.name").alias("a")).groupBy("kind", "a").agg(F.count("*").alias("n")).union(edges.join(names, "dst").groupBy(F.lit("edge"), "a").agg(F.count("*")))


@query("record_subgraph_counts", """
select 'Order' as kind, count(*) as count from orders union all select 'Customer', count(distinct o_custkey) from orders
union all select 'Status', count(*) from (select distinct o_orderstatus, o_orderpriority from orders) union all select 'Clerk', count(distinct o_totalprice) from orders
union all select 'HAS_RECORD', count(*) from orders union all select 'HAS_STATUS', count(*) from orders union all select 'HAS_PRICE', count(*) from orders""")
def record_subgraph_counts(t):
    groups = {"status": ("Status", "HAS_STATUS", ["o_orderstatus", "o_orderpriority"]), "price": ("Clerk", "HAS_PRICE", ["o_totalprice"])}
    nodes, edges = G.record_subgraph(t("orders"), "o_orderkey", "o_custkey", groups, "Customer", "Order")
    counts = G.label_counts(G.merge_nodes(nodes)).toDF("kind", "count")
    return counts.union(G.type_counts(G.merge_edges(edges)))
