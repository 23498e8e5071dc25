"""Domain graphs, evidence, lenses and campaigns on the survey's fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import domain, lenses
from granary.operators import graph as G
from granary.streaming import campaign

OXIDE = {
    "Ref_internal_sample_id": "oxide_paper_device_1", "Ref_DOI_number": "10.0000/example", "_domain_profile": "oxide_perovskite", "Domain_system_or_subject": "La0.7Sr0.3MnO3", "Domain_composition_formula": "La0.7Sr0.3MnO3",
    "Domain_a_site_species": json.dumps(["La", "Sr"]), "Domain_b_site_species": json.dumps(["Mn"]), "Domain_crystal_structure": "rhombohedral",
    "Domain_measurements": json.dumps([{"name": "conductivity", "value": 120, "unit": "S/cm", "context": "300 K"}]), "_evidence_Domain_measurements": "The conductivity was 120 S/cm at 300 K.",
}
BATTERY = {"Ref_internal_sample_id": "b1", "Ref_DOI_number": "10.0/b", "_domain_profile": "battery_cells", "Domain_system_or_subject": "cell", "Domain_cathode_material": "LFP", "Domain_cell_format": json.dumps(["CR2032", "pouch cell"]), "_evidence_Domain_cathode_material": "LFP cathodes were used."}


def graph(spark, row, index=None):
    df = spark.createDataFrame([tuple(row.values()) + (1,)], ", ".join(f"{k} string" for k in row) + ", seq int")
    nodes, edges = domain.domain_subgraph(df, "Ref_internal_sample_id", "Ref_DOI_number", "seq", index)
    return {r.id: r for r in G.merge_nodes(nodes).collect()}, G.merge_edges(edges).collect()


def test_oxide_record_has_no_device(spark):
    nodes, edges = graph(spark, OXIDE)
    labels = {label for n in nodes.values() for label in n.labels}
    assert {"OxidePerovskite", "DomainMeasurement", "StudiedSystem", "Chemical"} <= labels and "Device" not in labels
    assert {e.type for e in edges} == {"STUDIES_SYSTEM", "HAS_COMPOSITION", "HAS_A_SITE_SPECIES", "HAS_B_SITE_SPECIES", "HAS_CRYSTAL_STRUCTURE", "HAS_MEASUREMENT", "HAS_TEXT_EVIDENCE", "SUPPORTS_ENTITY_OR_MEASUREMENT"}
    (m,) = [n for n in nodes.values() if "DomainMeasurement" in n.labels]
    assert m.properties == {"name": "conductivity", "value": "120", "unit": "S/cm", "context": "300 K", "domain_profile": "oxide_perovskite"}
    ends = {e.src for e in edges} | {e.dst for e in edges}
    assert {i for i in ends if i not in nodes} == {next(e.src for e in edges if e.type == "STUDIES_SYSTEM")}  # the paper's own node comes from elsewhere


def test_unknown_fields_are_attributes_with_canonical_names(spark):
    index = spark.createDataFrame([("lfp", "lithium iron phosphate", "material")], "norm string, term string, category string")
    nodes, edges = graph(spark, BATTERY, index)
    attributes = {n.properties["name"]: n.properties for n in nodes.values() if "DomainAttribute" in n.labels}
    assert set(attributes) == {"lithium iron phosphate", "CR2032", "pouch cell"}
    lfp = attributes["lithium iron phosphate"]
    assert (lfp["raw_name"], lfp["ontology_category"], lfp["domain_field"]) == ("LFP", "material", "Domain_cathode_material")
    assert sum(e.type == "HAS_DOMAIN_ATTRIBUTE" for e in edges) == 3 and sum(e.type == "SUPPORTS_ENTITY_OR_MEASUREMENT" for e in edges) == 1


def test_split_values(spark):
    cells = [None, "", "n/a", "a; b|a\nc", '["x", " y ", null, "NA"]', "[not json", "'q'"]
    got = [r.v for r in spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").orderBy("k").select(domain.split_values(F.col("c")).alias("v")).collect()]
    assert got == [[], [], [], ["a", "b", "c"], ["x", "y"], ["not json"], ["q"]]


def test_evidence_once_and_at_most_thirty(spark):
    rows = [("p", f"Text  {k // 2}", "f", k) for k in range(100)] + [("p", "text 0", "g", -1), ("q", " ", "f", 0), ("q", None, "f", 0), ("q", "One", "f", 5)]
    found = domain.evidence_candidates(spark.createDataFrame(rows, "paper string, text string, field string, at int"), "paper", "text", "field", "at")
    got = found.collect()
    assert sorted((r.seq, r.text) for r in got if r.paper == "p") == [(-1, "text 0")] + [(2 * k, f"Text  {k}") for k in range(1, 30)]
    assert [(r.seq, r.text) for r in got if r.paper == "q"] == [(5, "One")]
    nodes, edges = domain.evidence_graph(found, "paper", "TextEvidence", ["Evidence", "TextEvidence"], "HAS_TEXT_EVIDENCE", "raw")
    assert G.merge_nodes(nodes).count() == 31 and edges.count() == 31
    assert domain.evidence_candidates(spark.createDataFrame(rows, "paper string, text string, field string, at int"), "paper", "text", "field", "at", None).count() == 51


def test_lenses(spark):
    nodes = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")
    edges = spark.createDataFrame([("d1", "a", "USES_ABSORBER"), ("d1", "b", "HAS_STABILITY_TEST"), ("d1", "c", "HAS_STABILITY_TEST"), ("d2", "e", "FABRICATED_BY"), ("d3", "f", "OTHER"), ("zz", "f", "FABRICATED_BY")], "src string, dst string, type string")
    made, found, report = lenses.decomposition_lens(nodes, edges, lenses.DEVICE_STEPS)
    assert {r.name for r in made.collect()} == {"1. absorber material", "4. stability test", "2. fabrication/process"} and report.count() == 3
    assert {t: found.where(F.col("type") == t).count() for t in ("POLICY_DECOMPOSES_STEP", "HAS_DECOMPOSITION_STEP", "NEXT_REASONING_STEP")} == {"POLICY_DECOMPOSES_STEP": 3, "HAS_DECOMPOSITION_STEP": 3, "NEXT_REASONING_STEP": 1}
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "N") for k in range(12)] + [("x", "y", "N"), ("n3", "z", "M")], "src string, dst string, type string")
    assert {(r.head, r.id): r.place for r in lenses.walk_chains(chain, "N").collect()} == {("n0", f"n{k}"): k for k in range(13)} | {("x", "x"): 0, ("x", "y"): 1}
    claims = spark.createDataFrame([("c1", "s" * 200, "evidence_linked"), ("c2", "t" * 200, None), ("c3", None, "summary_only")], "id string, statement string, support_status string")
    gaps, to, said = lenses.gap_lens(claims, nodes, spark.createDataFrame([("d1", "c1", "ASSERTS_CLAIM")], "src string, dst string, type string"))
    assert sorted((r.node, r.status) for r in said.collect()) == [("c2", "needs_evidence"), ("c3", "needs_evidence"), ("d2", "limited_knowledge"), ("d3", "limited_knowledge")]
    assert gaps.count() == 4 and max(len(r.name) for r in gaps.collect()) == len("Need stronger evidence for: ") + 140 and to.where("type = 'HAS_UNCERTAINTY_GAP'").count() == 4


def test_campaign_goes_on_after_it_was_killed(spark, tmp_path):
    pages = {"a": [("1", True), ("2", False)], "b": [("2", True), ("3", True), (None, True)], "c": [("4", False)], "d": [("5", True), ("6", True)], "e": [("7", True)]}
    asked = []

    def collect(q, n, fail=None):
        asked.append(q)
        if q == fail:
            raise RuntimeError("killed")
        return spark.createDataFrame(pages[q], "key string, ready boolean")

    new = lambda papers, ready, rounds=0: campaign.Campaign(spark, str(tmp_path / "c"), list("abcde"), papers, ready, rounds)
    with pytest.raises(RuntimeError):
        new(5, 4).run(lambda q, n: collect(q, n, "c"))
    assert [(r.papers, r.ready) for r in new(5, 4).ledger().orderBy("round").collect()] == [(2, 1), (3, 2)]
    half = new(5, 4).found().where("round = 0").withColumn("round", F.lit(2))  # what a round had written when it was cut off goes
    half.write.mode("append").partitionBy("round").parquet(str(tmp_path / "c" / "found"))
    assert new(5, 4).run(collect) == "targets_met" and asked == ["a", "b", "c", "c", "d"]
    assert sorted((r.key, r.round) for r in new(5, 4).found().collect()) == [("1", 0), ("2", 0), ("3", 1), ("4", 2), ("5", 3), ("6", 3)]
    assert new(99, 99, 5).run(collect) == "attempts_exhausted" and new(99, 99).run(collect) == "plan_exhausted"
    assert new(1, 1).run(collect) == "targets_met" and asked[-1] == "e"
