"""Text recovery, anchored numbers, evidence and statements on sentences with known values, and against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.operators import extraction as X
from granary.operators import recovery, rules, running
from granary.operators import quality as Q

TEXTS = [
    "The perovskite film was annealed at 100 °C for 10 min. SnO2 (30 nm) was spin-coated. The active area was 0.09 cm2. DMF and DMSO in a 4:1 ratio; solvent ratio DMF:DMSO 4:1 was used.",
    "Devices were kept unencapsulated in ambient air at 65 C and 40% RH under 1 sun. T95 of 1,200 h for the device under MPP and ISOS stability; T80 = 2000 h of stability in nitrogen.",
    "The champion device reached a PCE of 21.6%. Another cell showed a PCE of 19.2 % and 19.2% PCE. FAPbI3 based.",
    None, "", "annealing only, no number. " * 200, "Au 80 nm thermally evaporated. Spiro by spin coating " + "x" * 50_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, text string")


def test_fields_near_anchors(docs):
    got = {(r.id, r.field): r.value for r in X.fields_near(docs, "id", "text").collect()}
    assert got[0, "annealing_temperature"] == "100.0" and got[0, "annealing_time"] == "10.0" and got[0, "cell_area"] == "0.09"
    assert got[0, "electron_layer_thickness"] == "30.0" and got[0, "electron_layer_method"] == "spin coating"
    assert got[6, "contact_thickness"] == "80.0" and got[6, "contact_method"] == "spin coating; thermal evaporation" and got[6, "hole_layer_method"] == "spin coating; thermal evaporation"
    assert {i for i, _ in got} <= {0, 2, 6}


def test_conditions_and_terms(docs):
    got = docs.select("id", *(c.alias(n) for n, c in X.stability_conditions(F.col("text")).items()), X.formula(F.col("text")).alias("formula"), *(c.alias(n) for n, c in X.solvents_and_ratio(F.col("text")).items())).collect()
    r = got[1]
    assert (r.temperature_c, r.rh_percent, r.light, r.atmosphere, r.encapsulation) == (65.0, 40.0, 1.0, "ambient; air; nitrogen", "False")
    assert got[2].formula == "FAPbI3" and got[0].solvents == "DMF; DMSO" and got[0].ratio == "4:1"
    assert got[3].temperature_c is None and got[3].atmosphere is None and got[3].formula is None


def plain_sentence(text, pattern, most=1000):
    for m in re.finditer(pattern, text, re.I):
        start = text.rfind(".", 0, m.start()) + 1
        ends = [x for x in (text.find(".", m.end()), text.find("\n", m.end())) if x != -1]
        if found := re.sub(r"\s+", " ", text[start : min(ends) if ends else len(text)]).strip():
            return found[:most]
    return ""


def test_sentence_like_plain_python(spark):
    texts = ["One. Two solvent here. Three", "solvent", "a\nb solvent c\nd. e", "none", "", "x. a DMF b. DMF", "lead. In 3 parts solvent\nnext"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.sentence_with(F.col("t"), X.SOLVENT_SENTENCE).alias("s")).collect()
    assert [r.s for r in got] == [plain_sentence(t, X.SOLVENT_SENTENCE) for t in texts]


def test_candidates_and_evidence(spark, docs):
    assert [(r.id, r.candidate) for r in X.audit_candidates(docs, "id", "text").collect()] == [(2, 21.6), (2, 19.2)]
    t = docs.withColumn("target", F.when(F.col("id") == 2, 21.63).when(F.col("id") == 1, 50.0))
    found = X.matching_evidence(t, "id", "text", "target", [recovery.EXPLICIT_AFTER]).collect()
    assert [r.id for r in found] == [2] and "21.6%" in found[0].evidence
    assert [(r.id, r["values"]) for r in recovery.recover(docs, "id", "text", recovery.LIFETIME_95).collect()] == [(1, [1200.0])]


def test_statement_prefix(spark):
    row = spark.range(1).select(rules.parse_statement(F.lit("The study shows that grain boundary passivation significantly improves the device efficiency, which is good.")).alias("s")).first().s
    assert (row.subject, row.relation, row.object) == ("grain boundary passivation", "IMPROVES", "device efficiency")


def test_pairs_keys_and_depth(spark):
    assert spark.range(1).select(N.parse_pairs(F.lit("a=1; b=2; a=3; c")).alias("m")).first().m == {"a": "3", "b": "2"}
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(101)] + [("k005",), (None,)], "k string")
    assert sorted(r.k for r in Q.evenly_spaced(keys, "k", 5).collect()) == ["k000", "k025", "k050", "k075", "k100"]
    ranked = running.running_before(keys.where("k is not null").distinct().withColumn("n", F.lit(1)), "k", ["n"], ranges=7).orderBy("k").collect()
    assert [r.n_before for r in ranked] == list(range(101))
    deep = '{"a":' * 12 + "1" + "}" * 12
    got = rules.json_paths(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j").collect()
    assert [(r.path, r.value) for r in got] == [(".".join("a" * 12), "1")]


def test_side_values_try_the_next_pattern_and_case_counts():
    text = "The champion device reached a PCE of 21.2% with a Voc of 9 V, open-circuit voltage of 1.12 V and FF = 79%."
    best = recovery.candidates(text, recovery.PERFORMANCE)[0]
    assert best["values"] == [21.2] and best["sides"] == {"voc": 1.12, "ff": 79.0} and best["score"] == 4 + 3 + 3 + 1 + 1
    assert recovery.candidates(text.replace("PCE", "pce"), recovery.PERFORMANCE) == []  # 8 points: lower-case letters are no PCE


def test_audit_has_patterns_of_its_own(spark):
    df = spark.createDataFrame([(1, "The champion device showed 21.3% efficiency under light. The PCE was 18% and again PCE of 18 %. The cell yield was 12%. EQE 25% PCE."), (2, None)], "id int, t string")
    assert [(r.id, r.candidate) for r in X.audit_candidates(df, "id", "t").collect()] == [(1, 25.0), (1, 21.3), (1, 18.0)]


def test_whole_records_are_filled_once(spark):
    text = (
        "The champion inverted device, ITO/PTAA/FAPbI3/PCBM/Ag, reached a PCE of 21.2% with Voc = 1.12 V, Jsc of 24.1 mA cm-2 and FF = 79%. Films were annealed at 100 °C for 10 min from DMF:DMSO 4:1 with MACl. The active area was 0.09 cm2. "
        "PCBM of 30 nm was spin-coated. The unencapsulated cell retained 92% of its initial efficiency after 1000 h under 1 sun illumination in nitrogen at 65 °C."
    )
    rows = [(1, text, None, None, None), (2, text, 18.0, "kept", " "), (3, None, None, None, None), (4, "nothing", 2.0, None, None)]
    got = {r.id: r for r in X.recover_records(spark.createDataFrame(rows, "id int, t string, JV_default_PCE double, Cell_architecture string, Encapsulation string"), "id", "t").collect()}
    one, two = got[1], got[2]
    assert (one.JV_default_PCE, one.JV_default_Voc, one.JV_default_Jsc, one.JV_default_FF) == (21.2, 1.12, 24.1, 0.79)
    assert (one.Perovskite_composition_short_form, one.ETL_stack_sequence, one.HTL_stack_sequence, one.Backcontact_stack_sequence, one.Cell_architecture) == ("FAPbI3", "PCBM", "PTAA", "Ag; ITO", "inverted")
    assert (one.Perovskite_deposition_thermal_annealing_temperature, one.Perovskite_deposition_thermal_annealing_time, one.Cell_area_measured) == ("100.0", "10.0", "0.09")
    assert one.Perovskite_deposition_solvents == "DMF; DMSO" and one.Perovskite_deposition_solvents_mixing_ratios == "4:1" and one.Perovskite_additives_compounds == "MACl"
    assert (one.Stability_PCE_end_of_experiment, one.Stability_time_total_exposure, one.Stability_PCE_after_1000_h, one.Encapsulation, one.Stability_atmosphere) == (92.0, 1000.0, 92.0, "False", "nitrogen")
    log = {c.field: (c.value, c.evidence) for c in one._changes}
    assert log["JV_default_PCE"][0] == "21.2" and "champion" in log["JV_default_PCE"][1] and "retained 92%" in log["Stability_PCE_after_1000_h"][1]
    assert (two.JV_default_PCE, two.JV_default_Voc, two.Cell_architecture, two.Encapsulation, two.ETL_stack_sequence) == (18.0, None, "kept", "False", "PCBM")
    assert got[3]._changes == [] and got[4]._changes == [] and got[4].JV_default_PCE == 2.0


def test_search_near_what_matches_hold_finds_the_same():
    import random
    from dataclasses import replace

    rng = random.Random(3)
    parts = ["The champion device reached a PCE of 21.2%", "device " + "x " * 60 + "efficiency of 19%", "retained 92% of it after 1000 h", "T80 of 500 h", "300 hours was T 95", "12% PCE", "no number", "%", ". ", "filler words " * 90, "\n"]
    for _ in range(150):
        text = " ".join(rng.choices(parts, k=rng.randrange(1, 9)))
        for spec in (recovery.PERFORMANCE, recovery.AUDITED, recovery.LIFETIME, recovery.LIFETIME_95, recovery.RETAINED):
            assert recovery.candidates(text, spec) == recovery.candidates(text, replace(spec, holds=None))


def test_a_documents_own_words_are_not_beside_the_made_sentences(spark, tmp_path):
    import duckdb

    import oracle
    from granary.plans import recovery as plan
    from granary.plans import registry

    words = ["A. All rights reserved.", "A review of the literature.", "A loss of it, by a perspective.", "The references, by permission of the publisher.", None, ""]
    spark.createDataFrame([(k, words[k % 6]) for k in range(5375, 5500)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("recovered_records", "retained_after_hours", "candidate_audit"):
        oracle.compare(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLE_SQL[name])
    specs = (recovery.PERFORMANCE, recovery.LIFETIME, recovery.RETAINED, recovery.AUDITED)
    assert len(plan.BETWEEN) > max(s.width for s in specs) and not any(re.search(c.pattern, plan.BETWEEN, re.I) for s in specs for c in s.clues if c.pattern)


def test_records_are_read_beside_their_rows(spark):
    texts = ["The champion device reached a PCE of 21.2%.", None, "The champion device reached a PCE of 19.5%. Ag."]
    df = spark.createDataFrame([(k, t) for k, t in zip((1, 1, None), texts)], "id int, t string")
    got = X.recover_records(df, "id", "t")
    assert {(r.id, r.JV_default_PCE, r.Backcontact_stack_sequence) for r in got.collect()} == {(1, 21.2, None), (1, None, None), (None, 19.5, "Ag")} and got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and sum(line.count("ArrowEvalPython [") for line in plan.splitlines()) == 1


def test_what_decides_whether_a_pattern_is_tried_loses_nothing():
    import random
    from dataclasses import replace

    rng = random.Random(5)
    parts = [*X.ATMOSPHERES, *X.SOLVENTS, *X.ADDITIVES, *X.ELECTRON_TERMS, *X.HOLE_TERMS, *X.CONTACT_TERMS, "anneal", "active area 1 cm2", "area", "ETL", "hole transport layer 20 nm", "back contact", "spin coating", "slot-die 3 nm", "ALD", "CBD", "12% PCE", "device efficiency of 9%",
             "retains 90% for 900 h", "T 80 of 9 h", "T95 9 h", "FAPbI3", "CsSn0.5I3", "RH 4%", "1 sun", "9 mW cm-2", "ſputtering", "MACl", "Kı", "p-i-n", "nip", "İTO", "inverted", "x", "é", "_", ".", "\n", "\t \n", "\u00a0", "%"]
    plain = lambda t, text: bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])", text, re.I))
    for _ in range(400):
        text = "".join(p + rng.choice(["", " ", "  ", " ", ", "]) for p in rng.choices(parts, k=rng.randrange(0, 12)))
        text = rng.choice([text, text.swapcase()])
        whole, low = recovery.squeezed(text), recovery.folded(text)
        assert whole == re.sub(r"\s+", " ", text) and len(low) == len(text)
        words = X.words_of(low, X.WANTED)
        for t in X.TERMS:
            assert X.terms_found(text, words, [t]) == (t if plain(t, text) else None), (t, text)
        for way in (w for ways in X.PRIORITY_FIELDS.values() for w in ways):
            assert way.may_find(low, words) or way.find(text) is None, (way, text)
        for name, (some, p) in X.SHAPES.items():
            assert some & words or not re.search(p, text.lower()), (name, text)
        assert X.SOLVENT_WORDS & words or X.sentence_in(text, X.SOLVENT_SENTENCE) == "" and not re.search(X.SOLVENT_RATIO, text, re.I), text
        assert X.formula_in(text, low) == X.formula_in(text, "pbi"), text
        c = X.conditions_in(whole, recovery.folded(whole), words)
        assert c["rh_percent"] == X.first_number(whole, "", X.HUMIDITY, 0, 100) and (c["light"] is not None) == (X.first_number(whole, "", X.LIGHT, 0.01, 1000) is not None), text
        for spec in (recovery.PERFORMANCE, recovery.AUDITED, recovery.LIFETIME, recovery.LIFETIME_95, recovery.RETAINED):
            assert recovery.candidates(text, spec) == recovery.candidates(text, replace(spec, tells=())), (spec, text)


def test_records_are_filled_from_the_end_of_long_texts(spark):
    filler = "Nothing is said of it in this line. " * 1_000
    made = "The planar cells had SnO2 (30 nm, blade coated), PTAA of 15 nm and Ag of 80 nm. MAPbI3 films with MACl were annealed at 120 °C for 20 min and washed in isopropanol. The active area was 0.09 cm2."
    long = "The films were " + "very " * 2_000 + "slowly made with a PEAI additive from the solvents DMF:DMSO 4:1 at last."
    rows = [(1, filler + made + filler, 18.0), (2, filler + long, 18.0), (3, "x " * 20_000 + made, 2.0), (4, filler + "The champion device reached a PCE of 21.2%. " + filler + made, None)]
    got = {r.id: r for r in X.recover_records(spark.createDataFrame(rows, "id int, t string, JV_default_PCE double"), "id", "t").collect()}
    for r in (got[1], got[4]):
        assert (r.ETL_stack_sequence, r.HTL_stack_sequence, r.Backcontact_stack_sequence, r.Cell_stack_sequence, r.Cell_architecture) == ("SnO2", "PTAA", "Ag", "SnO2 / perovskite / PTAA / Ag", "regular")
        assert (r.ETL_thickness, r.HTL_thickness_list, r.ETL_deposition_procedure, r.Cell_area_measured) == ("30.0", "30.0", "blade coating", "0.09") and r.Backcontact_thickness_list == "30.0"
        assert (r.Perovskite_deposition_thermal_annealing_temperature, r.Perovskite_deposition_thermal_annealing_time, r.Perovskite_additives_compounds, r.Perovskite_deposition_solvents) == ("120.0", "20.0", "MACl", "isopropanol")
    two = got[2]
    assert (two.Perovskite_deposition_solvents, two.Perovskite_deposition_solvents_mixing_ratios, two.Perovskite_additives_compounds) == ("DMF; DMSO", "4:1", "PEAI")
    log = {c.field: c.evidence for c in two._changes}
    assert len(log["Perovskite_deposition_solvents"]) > 10_000 and log["Perovskite_deposition_solvents_mixing_ratios"].endswith("DMF:DMSO 4:1 at last") and "PEAI" in log["Perovskite_additives_compounds"]
    assert got[3]._changes == []
    whole = X.solvents_and_ratio(F.col("t"))
    assert spark.createDataFrame([(filler + "ethanol",)], "t string").select(whole["solvents"]).first()[0] == "ethanol"
