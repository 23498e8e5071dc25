"""Property graphs as two tables: nodes(id, label or labels, properties) and edges(rel_id, src, dst, type, properties)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import fingerprint, stable_id


def unpivot_observations(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, value) for every non-empty cell, as text."""
    long = df.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(key, list(columns), "field", "value")
    return long.where(F.trim(F.coalesce("value", F.lit(""))) != "")


def merge_nodes(candidates: DataFrame, last_wins: bool = True, order: str = "seq") -> DataFrame:
    """candidates(id, label, properties map, seq) -> nodes(id, labels, properties).

    Of each property the last (or first) non-empty value stays; labels are the set of all, sorted.
    """
    pick = F.max_by if last_wins else F.min_by
    entries = candidates.select("id", order, F.explode(F.map_entries("properties")).alias("e")).where(F.trim(F.coalesce(F.col("e.value"), F.lit(""))) != "")
    values = entries.groupBy("id", F.col("e.key").alias("key")).agg(pick(F.col("e.value"), F.col(order)).alias("value"))
    maps = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    labels = candidates.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.join(maps, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def merge_edges(candidates: DataFrame, last_wins: bool = True, order: str = "seq") -> DataFrame:
    """candidates(src, dst, type, properties, seq) -> edges, one for each content; its id is a hash of ends, type and properties.

    Columns are picked one by one, all from the same row, so that those nobody asks for are neither shuffled nor sorted.
    """
    pick = F.max_by if last_wins else F.min_by
    keyed = candidates.withColumn("rel_id", stable_id("rel", "src", "type", "dst", fingerprint("properties")))
    return keyed.groupBy("rel_id").agg(*(pick(F.col(c), F.col(order)).alias(c) for c in ("src", "dst", "type", "properties")))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel_id, end): edges of which an end is no node."""
    ids = nodes.select(F.col("id").alias("_id"))
    missing = lambda c: edges.join(ids, F.col(c) == F.col("_id"), "left_anti").select("rel_id", F.lit(c).alias("end"))
    return missing("src").union(missing("dst"))


def missing_properties(df: DataFrame, id_column: str, kind: Column, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, missing): required properties of the row's kind that it doesn't have."""
    need = F.element_at(F.create_map(*(x for k, names in required.items() for x in (F.lit(k), F.array(*map(F.lit, names))))), kind)
    return df.select(F.col(id_column).alias("id"), F.array_except(F.coalesce(need, F.array().cast("array<string>")), F.map_keys("properties")).alias("missing")).where(F.size("missing") > 0)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("node_type")).groupBy("node_type").agg(F.count("*").alias("count"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("type").alias("relationship_type")).agg(F.count("*").alias("count"))


def schema_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_label, type, target_label, count) by the ends' first labels."""
    first = nodes.select("id", F.get("labels", F.lit(0)).alias("label"))
    a, b = first.toDF("src", "source_label"), first.toDF("dst", "target_label")
    return edges.join(a, "src").join(b, "dst").groupBy("source_label", "type", "target_label").agg(F.count("*").alias("count"))


def relationship_patterns(statements: DataFrame, paper: str, order: str) -> DataFrame:
    """statements(subject, relation, object, paper, claim) -> distinct papers and claims, and the first statement, of each pattern."""
    return statements.groupBy("subject", "relation", "object").agg(F.count_distinct(paper).alias("papers"), F.count_distinct("claim").alias("claims"), F.min_by("claim", order).alias("first_claim"))


def opposition_tension(edges: DataFrame, opposites: Mapping[str, str]) -> DataFrame:
    """(src, dst, types, count): pairs of nodes that are joined by a relation and by its opposite."""
    by = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("count"))
    against = F.create_map(*(F.lit(x) for pair in opposites.items() for x in pair))
    return by.where(F.exists("types", lambda t: F.coalesce(F.array_contains("types", F.element_at(against, t)), F.lit(False))))


def sequence_links(df: DataFrame, group: str, position: str, item: str) -> DataFrame:
    """(group, src, dst, step): each item and the next one of its group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(group).orderBy(position)
    return df.select(group, F.col(item).alias("src"), F.lead(item).over(w).alias("dst"), F.row_number().over(w).cast("long").alias("step")).where("dst is not null")


def knowledge_cards(papers: DataFrame, claims: DataFrame, paper: str, claim: str) -> DataFrame:
    """A JSON card for each paper with its claims, sorted."""
    listed = claims.groupBy(paper).agg(F.array_sort(F.collect_list(F.struct(claim, "statement"))).alias("claims"))
    return papers.join(listed, paper, "left").select(paper, F.to_json(F.struct(paper, "title", "claims")).alias("card"))


def ontology_index(synonyms: DataFrame, order: str) -> DataFrame:
    """synonyms(term, synonym, order) -> (norm, term): the first term that has a spelling wins."""
    norm = F.lower(F.trim(F.regexp_replace("synonym", r"\s+", " ")))
    return synonyms.withColumn("norm", norm).groupBy("norm").agg(F.min_by("term", order).alias("term"))


def attach_evidence(observations: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations with what the evidence of the same keys says, one row for each piece of evidence; an observation without any stays."""
    return observations.join(evidence, list(keys), "left")


def missing_required(df: DataFrame, kind: Column, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with missing: required properties of the row's kind that are absent, null or empty; rows that lack none go."""
    need = F.coalesce(F.element_at(F.create_map(*(x for k, names in required.items() for x in (F.lit(k), F.array(*map(F.lit, names))))), kind), F.array().cast("array<string>"))
    empty = F.filter(need, lambda k: F.coalesce(F.trim(F.element_at("properties", k)), F.lit("")).isin("", "[]"))
    return df.withColumn("missing", empty).where(F.size("missing") > 0)


def graph_checks(nodes: DataFrame, edges: DataFrame, node_properties: Mapping[str, Sequence[str]], edge_properties: Mapping[str, Sequence[str]], claim: str = "ScientificClaim", support: str = "SUPPORTED_BY", directional: str = "DIRECTIONAL_RELATION", guards: Sequence[str] = ("causal_status", "claim_id", "evidence_id")) -> DataFrame:
    """(check, violations): dangling edges, nodes and edges without required properties, claims that nothing supports, directional edges without their guards.

    nodes(id, label, properties), edges(rel_id, src, dst, type, properties), properties a map of text.
    """
    claims = nodes.where(F.col("label") == claim).select("id").distinct()
    supported = edges.where(F.col("type") == support).select(F.col("src").alias("id")).distinct()
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    found = [
        count("dangling_relationships", dangling(nodes, edges).select("rel_id").distinct()),
        count("required_node_property_violations", missing_required(nodes, F.col("label"), node_properties)),
        count("required_relationship_property_violations", missing_required(edges, F.col("type"), edge_properties)),
        count("unsupported_claims", claims.join(supported, "id", "left_anti")),
        count("unguarded_directional_relations", missing_required(edges.where(F.col("type") == directional), F.lit(directional), {directional: guards})),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def claim_support(links: DataFrame, claim: str, kind: str, thresholds: Mapping[str, float], least_shared: int = 2) -> DataFrame:
    """(claim, <kind>_support_count, evidence_support_count, support_status) from links(claim, kind, shared, score).

    A link counts if it shares enough words and its overlap reaches the threshold of its kind; claims without a link that
    counts are summary_only.
    """
    reaches = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in thresholds.items() for x in p)), F.col(kind)) <= F.col("score"), F.lit(False)) & (F.col("shared") >= least_shared)
    each = [F.count_if(reaches & (F.col(kind) == k)).alias(f"{k}_support_count") for k in thresholds]
    s = links.groupBy(claim).agg(*each, F.count_if(reaches).alias("evidence_support_count"))
    return s.withColumn("support_status", F.when(F.col("evidence_support_count") > 0, "evidence_linked").otherwise("summary_only"))


def evidence_lens(claims: DataFrame, policy: str, claim: str = "id") -> DataFrame:
    """Edges from a policy to all claims: it prioritises those with linked evidence and flags the others."""
    kind = F.when(F.col("support_status") == "evidence_linked", "POLICY_PRIORITIZES_EVIDENCE_LINKED_CLAIM").otherwise("POLICY_FLAGS_WEAK_EVIDENCE")
    return claims.select(F.lit(policy).alias("src"), F.col(claim).alias("dst"), kind.alias("type"))


def node_relations(nodes: DataFrame, edges: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, has_<group>): whether a node has an outgoing edge of one of the group's types."""
    flags = edges.groupBy(F.col("src").alias("id")).agg(*(F.bool_or(F.col("type").isin(list(types))).alias(f"has_{g}") for g, types in groups.items()))
    return nodes.select("id").join(flags, "id", "left").na.fill(False, [f"has_{g}" for g in groups])


def constraint_warnings(nodes: DataFrame, edges: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, missing): nodes that lack an outgoing edge of some group, and the groups that they lack."""
    flags = node_relations(nodes, edges, groups)
    return flags.select("id", F.array_compact(F.array(*(F.when(~F.col(f"has_{g}"), F.lit(g)) for g in groups))).alias("missing")).where(F.size("missing") > 0)


def supported_nodes(edges: DataFrame, support: str) -> DataFrame:
    """(id): nodes that an edge of support ends at, or that have an outgoing edge to a node at which one ends.

    Ends of support are made distinct before they are joined to edges, so no pair of edges is formed.
    """
    ends = edges.where(F.col("type") == support).select(F.col("dst").alias("_end")).distinct()
    reached = edges.join(ends, F.col("dst") == F.col("_end"), "left_semi").where(F.col("type") != support).select(F.col("src").alias("id"))
    return ends.select(F.col("_end").alias("id")).union(reached).distinct()


def abstraction_lens(nodes: DataFrame, classes: Mapping[str, str], policy: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an abstraction: a node for each class of labels, and from every node an INSTANCE_OF edge to the class of its label."""
    known = F.element_at(F.create_map(*(F.lit(x) for p in classes.items() for x in p)), F.col("label"))
    placed = nodes.select("id", known.alias("class")).where("class is not null")
    made = placed.select("class").distinct().select(stable_id("class", F.lit(policy), "class").alias("id"), F.lit("AbstractClass").alias("label"), F.create_map(F.lit("name"), F.col("class")).alias("properties"))
    return made, placed.select(F.col("id").alias("src"), stable_id("class", F.lit(policy), "class").alias("dst"), F.lit("INSTANCE_OF").alias("type"))


def record_subgraph(records: DataFrame, key: str, parent: str, groups: Mapping[str, tuple[str, str, Sequence[str]]], parent_label: str = "Paper", label: str = "Record") -> tuple[DataFrame, DataFrame]:
    """Node and edge candidates (for merge_nodes, merge_edges) of records: a node for each parent and record, and one for every group of columns that has a value.

    groups: name -> (label of the group's node, type of the edge from the record, columns that are its properties). Nodes
    of groups with the same values are one node. Candidates come in the order of the record's key.
    """
    props = lambda columns: F.map_filter(F.map_from_entries(F.array(*(F.struct(F.lit(c), F.trim(F.col(c).cast("string"))) for c in columns))), lambda _, v: F.coalesce(v, F.lit("")) != "")
    base = records.where(F.col(key).isNotNull())
    of_record, of_parent = stable_id(label, F.lit(key), key), stable_id(parent_label, F.lit(parent), parent)
    none = F.create_map().cast("map<string,string>")
    nodes = base.select(of_record.alias("id"), F.lit(label).alias("label"), props([key]).alias("properties"), F.col(key).alias("seq"))
    nodes = nodes.union(base.where(F.col(parent).isNotNull()).select(of_parent, F.lit(parent_label), props([parent]), F.col(key)))
    edges = base.where(F.col(parent).isNotNull()).select(of_parent.alias("src"), of_record.alias("dst"), F.lit("HAS_RECORD").alias("type"), none.alias("properties"), F.col(key).alias("seq"))
    for name, (kind, relation, columns) in groups.items():
        own = base.select(of_record.alias("_record"), props(columns).alias("properties"), F.col(key).alias("seq")).where(F.size("properties") > 0)
        own = own.withColumn("id", stable_id(name, fingerprint("properties")))
        nodes = nodes.union(own.select("id", F.lit(kind), "properties", "seq"))
        edges = edges.union(own.select("_record", "id", F.lit(relation), none, "seq"))
    return nodes, edges
