"""Lenses that reason over a whole graph: gaps of knowledge, decomposition into steps, classes; nodes (id, label, name, policy), edges (src, dst, type), report (policy, node, status, reason)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.normalize import clean, stable_id
from granary.sources.shared import written

# Edges by which a paper shows that something is known of it, and the steps into which devices and systems fall apart.
KNOWLEDGE = ("HAS_TEXT_EVIDENCE", "HAS_FIGURE_EVIDENCE", "ASSERTS_CLAIM")
DEVICE_STEPS = ((("USES_ABSORBER",), "absorber material"), (("FABRICATED_BY",), "fabrication/process"), (("HAS_PERFORMANCE_MEASUREMENT",), "performance metric"), (("HAS_STABILITY_TEST",), "stability test"))
SYSTEM_STEPS = (
    (("INCLUDES_ENTITY", "HAS_COMPOSITION"), "entities or composition"), (("PROCESSED_BY", "USES_METHOD", "USES_CHARACTERIZATION"), "methods or processing"),
    (("HAS_CONDITION", "TESTS_VARIABLE", "USES_COMPARISON"), "conditions or variables"), (("HAS_MEASUREMENT", "HAS_DOMAIN_ATTRIBUTE"), "measurements or domain attributes"),
)
STATEMENT_LENGTH = 140


def _nodes(rows: DataFrame, label: str, name: Column, policy: str) -> DataFrame:
    return rows.select("id", F.lit(label).alias("label"), name.alias("name"), F.lit(policy).alias("policy")).distinct()


def _edges(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))


def _report(rows: DataFrame, policy: str, node: str, status: str, reason: Column) -> DataFrame:
    return rows.select(F.lit(policy).alias("policy"), F.col(node).alias("node"), F.lit(status).alias("status"), reason.alias("reason"))


def gap_lens(claims: DataFrame, papers: DataFrame, edges: DataFrame, policy: str = "socratic_uncertainty", knowledge: Sequence[str] = KNOWLEDGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What needs more evidence: claims(id, statement, support_status) that aren't evidence_linked, and papers(id) without any edge of `knowledge`."""
    weak = claims.where(F.coalesce(F.nullif(clean("support_status"), F.lit("")), F.lit("unknown")) != "evidence_linked")
    weak = weak.select(F.col("id").alias("_of"), F.concat(F.lit("Need stronger evidence for: "), F.substring(F.coalesce("statement", F.lit("")), 1, STATEMENT_LENGTH)).alias("text"))
    weak = weak.withColumn("id", stable_id("UncertaintyGap", F.concat_ws("|", "_of", "text")))
    bare = papers.select(F.col("id").alias("_of")).join(edges.where(F.col("type").isin(*knowledge)).select(F.col("src").alias("_of")), "_of", "left_anti")
    bare = bare.withColumn("id", stable_id("UncertaintyGap", F.concat("_of", F.lit("|limited_extracted_knowledge"))))
    nodes = _nodes(weak, "UncertaintyGap", F.col("text"), policy).union(_nodes(bare, "UncertaintyGap", F.lit("Limited extracted knowledge for paper"), policy))
    found = _edges(weak, F.col("_of"), F.col("id"), "HAS_UNCERTAINTY_GAP").union(_edges(weak, F.lit(policy), F.col("id"), "POLICY_IDENTIFIES_GAP")).union(_edges(bare, F.col("_of"), F.col("id"), "HAS_UNCERTAINTY_GAP"))
    report = _report(weak, policy, "_of", "needs_evidence", F.lit("Summary-only claim needs direct support before being treated as strong knowledge"))
    return nodes, found, report.union(_report(bare, policy, "_of", "limited_knowledge", F.lit("Paper has little linked claim/evidence structure in current KG")))


def decomposition_lens(nodes: DataFrame, edges: DataFrame, steps: Sequence[tuple[Sequence[str], str]], policy: str = "cartesian_decomposition", what: str = "Device construction") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps, in order, of which nodes(id) have an outgoing edge, each linked from the node and to the next one that it has.

    Edges become, in one aggregate that combines before the shuffle, the few types that each node has; steps and links
    between neighbours follow from them in the row.
    """
    types = [x for s, _ in steps for x in s]
    has = edges.where(F.col("type").isin(*types)).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").groupBy("src").agg(F.array_sort(F.collect_set("type")).alias("_has"))  # at most as many as there are types
    present = lambda s: F.array_intersect("_has", F.array(*map(F.lit, sorted(s))))
    number = lambda k, s, name: F.when(F.size(present(s)) > 0, F.struct(F.lit(k).alias("step"), F.lit(name).alias("step_name"), F.array_join(present(s), "|").alias("types")))
    listed = has.select("src", F.array_compact(F.array(*(number(k, s, name) for k, (s, name) in enumerate(steps, 1)))).alias("_steps"))
    identified = listed.select("src", F.transform("_steps", lambda s: F.struct(s["step"].alias("step"), s["step_name"].alias("step_name"), stable_id("ReasoningStep", F.concat_ws("|", F.col("src"), F.lit(policy), s["step"].cast("string"), s["types"])).alias("id"))).alias("_steps"))
    rows = identified.select("src", F.posexplode("_steps").alias("at", "s"), "_steps").select("src", "s.*", F.try_element_at("_steps", F.col("at") + 2)["id"].alias("after"))
    made = _nodes(rows, "DecompositionStep", F.concat(F.col("step").cast("string"), F.lit(". "), "step_name"), policy)
    found = _edges(rows, F.lit(policy), F.col("id"), "POLICY_DECOMPOSES_STEP").union(_edges(rows, F.col("src"), F.col("id"), "HAS_DECOMPOSITION_STEP")).union(_edges(rows.where("after is not null"), F.col("id"), F.col("after"), "NEXT_REASONING_STEP"))
    return made, found, _report(rows, policy, "src", "decomposed", F.concat(F.lit(f"{what} decomposed through "), "step_name"))


def classification_lens(nodes: DataFrame, policy: str = "aristotelian_classification") -> tuple[DataFrame, DataFrame]:
    """nodes(id, labels, claim_type) by what they are: the first of their labels by name; claims by their type."""
    first = F.coalesce(F.try_element_at(F.array_sort("labels"), F.lit(1)), F.lit("Entity"))
    name = F.when(F.array_contains("labels", "Claim"), F.coalesce(F.nullif(clean("claim_type"), F.lit("")), F.lit("Claim"))).otherwise(first)
    rows = nodes.select(F.col("id").alias("_of"), F.coalesce(name, first).alias("name")).withColumn("id", stable_id("ReasoningCategory", F.concat(F.lit(f"{policy}|"), "name")))
    return _nodes(rows, "ReasoningCategory", F.col("name"), policy), _edges(rows, F.col("_of"), F.col("id"), "BELONGS_TO_REASONING_CATEGORY")


def walk_chains(edges: DataFrame, kind: str = "NEXT_REASONING_STEP", most_rounds: int = 20) -> DataFrame:
    """(head, id, place) of every node on chains of edges of one type: place 0 is a node that none leads to.

    A round doubles how far each node looks back, so a chain of n nodes takes about log n joins, each a written table in
    the shared folder; a chain of over 2^most_rounds nodes, or a cycle, is an error. A node that several lead to has a
    row for each way. A node without such edges is on no chain.
    """
    links = written(edges.where(F.col("type") == kind).select("src", "dst").distinct(), "links")
    rows = links.select(F.col("src").alias("head"), F.col("dst").alias("id"), F.lit(1).cast("long").alias("place"))
    for _ in range(most_rounds):
        before = rows.select(F.col("id").alias("_id"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        step = rows.join(before, F.col("head") == F.col("_id"), "left")
        rows = written(step.select(F.coalesce("_head", "head").alias("head"), "id", (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"), F.col("_head").isNotNull().alias("_moved")), "chains")
        if rows.where("_moved").isEmpty():
            heads = rows.select("head").distinct().select("head", F.col("head").alias("id"), F.lit(0).cast("long").alias("place"))
            return rows.select("head", "id", "place").union(heads)
        rows = rows.drop("_moved")
    raise ValueError(f"a cycle, or a chain of over {1 << most_rounds} nodes")
