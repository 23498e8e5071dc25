"""Device collapse, merges, backfill and annotation tables on the cases that the survey lists."""

from pyspark.sql import functions as F

from granary.operators import integration as I

DEVICE = "doi string, id string, composition string, stack string, pce double, voc double, hysteresis double, said_hysteresis string, said_pce string, seq int"


def test_duplicate_devices_keep_what_evidence_says(spark):
    same = ("10.1000/device", "CsPbI2Br", "ITO/NiOx/CsPbI2Br/PCBM/Ag", 15.44, 1.15)
    said = "The optimized passivated device achieves a champion PCE of 15.44%."
    rows = [
        (same[0], "paper_device_1_control_pce_14p82", *same[1:], 9.84, "The control device exhibits a hysteresis index of 9.84%.", said, 1),
        (same[0], "paper_device_1_control_pce_15p86", *same[1:], 1.55, "Upon asymmetric dual-interface passivation the index is 1.55%.", said, 2),
        (same[0], "paper_device_1_control_pce_13p48", same[1], "ITO/NiOx/PEAI/CsPbI2Br/PCBM/Ag", 13.48, None, None, None, "The bottom-interface passivated device reached a PCE of 13.48%.", 3),
        (same[0], "no_target", None, None, None, None, 2.0, None, None, 4),
    ]
    df = spark.createDataFrame(rows, DEVICE)
    got = {r.pce: r for r in I.collapse_devices(df, ["doi", "composition", "stack", "pce", "voc"], "id", "pce", "seq", {"pce": "said_pce", "hysteresis": "said_hysteresis"}).collect()}
    assert set(got) == {15.44, 13.48, None}
    champion = got[15.44]
    assert champion.hysteresis == 1.55 and champion.said_hysteresis.endswith("1.55%.")
    assert champion.id == "paper_device_1_target_pce_15p44" and champion.warning.startswith("Collapsed 2 duplicate")
    assert got[13.48].id == "paper_device_1_control_pce_13p48" and got[13.48].warning is None and got[None].id == "no_target"


def test_stated_numbers_are_whole_numbers(spark):
    rows = [(1.55, "it is 1.55%", True), (1.55, "it is 11.55", False), (1.55, "1.556", False), (1.5, "1.50 V", True), (2.0, "2 V", True), (2.0, "2.5 V", False), (15.44, "15.44.", True), (1.0, None, False)]
    df = spark.createDataFrame([(v, t, w, k) for k, (v, t, w) in enumerate(rows)], "v double, t string, want boolean, k int")
    assert [r.k for r in df.where(I.stated_in(F.col("v"), F.col("t")) != F.col("want")).collect()] == []


def test_same_device_merges_unless_it_contradicts_itself(spark):
    rows = [
        ("10.1/a", "device_1", "ITO/PEDOT/Ag", 17.21, 0.8, 2000, None, "Devices used ITO/PEDOT/Ag.", 2), ("10.1/a", "device_1", "Ag; ITO", 17.21, None, None, None, None, 1),
        ("10.1/b", "device_1", None, None, None, 2000, "Nitrogen", None, 1), ("10.1/b", "device_1", None, None, None, None, "Ambient air", None, 2), ("10.1/b", "device_1", "x", None, None, 5, "Ambient air", None, 3), (None, "device_1", None, 1.0, None, None, None, None, 1), (None, "device_1", None, 1.0, None, None, None, None, 2),
    ]
    df = spark.createDataFrame(rows, "doi string, id string, stack string, pce double, ff double, hours int, air string, said string, seq int")
    got = I.merge_same_device(df, ["doi", "id"], ["pce", "air"], "seq", {"stack": "said"}).collect()
    a = [r for r in got if r.doi == "10.1/a"]
    assert len(a) == 1 and (a[0].stack, a[0].hours, a[0].ff, a[0].pce) == ("ITO/PEDOT/Ag", 2000, 0.8, 17.21)
    assert sorted((r.air, r.hours, r.stack or "") for r in got if r.doi == "10.1/b") == [("Ambient air", 5, "x"), ("Nitrogen", 2000, "")]
    assert sum(r.doi is None for r in got) == 2


def test_backfill_never_changes_a_value(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", " ", 2), ("c", "kept", None), (None, None, None), ("d", "N/A", 4)], "k string, x string, y int")
    new = spark.createDataFrame([("a", "n/a", 5, 1), ("a", "second", 6, 2), ("b", "given", 7, 1), ("c", "other", 8, 1), (None, "nobody", 9, 1), ("z", "new", 1, 1)], "k string, x string, y int, seq int")
    rows, report = I.backfill_empty(old, new, "k", ["x", "y"], "seq")
    assert sorted((r.k or "", r.x, r.y) for r in rows.collect()) == [("", None, None), ("a", "second", 1), ("b", "given", 2), ("c", "kept", 8), ("d", "N/A", 4)]
    assert sorted((r.k, r.column, r.value) for r in report.collect()) == [("a", "x", "second"), ("b", "x", "given"), ("c", "y", "8")]


def test_outcomes_and_annotation_tables(spark):
    audit = spark.createDataFrame([(s,) for s in ("accepted", "accepted", "weak_accepted", "sparse_accepted", "rejected", "other", None)], "status string")
    assert I.integration_outcomes(audit).first().asDict() == {"accepted_total": 4, "accepted": 2, "weak_accepted": 1, "sparse_accepted": 1, "rejected": 1, "audited": 6}
    sample = spark.createDataFrame([("V1", "10.1/A", "s1", "5", None, "n/a", "h"), ("V2", None, "s1", None, "z", "w", "h")], "rec string, doi string, sid string, pce string, note string, extra string, _hash string")
    said = spark.createDataFrame([("10.1/a", "s1", "pce", "later", 2), ("10.1/A", "s1", "pce", "first", 1), ("10.1/a", "s2", "pce", "other sample", 0), ("", "s1", "note", "no doi", 1)], "doi string, sample_id string, field string, evidence string, seq int")
    got = sorted(tuple(r) for r in I.annotation_tables(sample, "rec", "doi", "sid", {"main": ["pce", "absent"]}, said, aside=["note"]).collect())
    assert got == [
        ("V1", "10.1/a", "s1", "core", "main", "absent", "", ""), ("V1", "10.1/a", "s1", "core", "main", "pce", "5", "first"),
        ("V2", "", "s1", "core", "main", "absent", "", ""), ("V2", "", "s1", "core", "main", "pce", "", ""), ("V2", "", "s1", "populated", "", "extra", "w", ""),
    ]


def test_wide_fractions_and_labels(spark):
    df = spark.createDataFrame([(1, "MA;FA", "1;3"), (2, "Cs", "2"), (3, "MA", "x"), (4, None, None)], "k int, ions string, c string")
    got = {r.k: (r["F_MA_fraction"], r["F_FA_fraction"], r["F_Cs_fraction"], r["F_valid"]) for r in I.wide_fractions(df, "ions", "c", "F").collect()}
    assert got == {1: (0.25, 0.75, 0.0, 1.0), 2: (0.0, 0.0, 1.0, 1.0), 3: (None, None, None, 0.0), 4: (None, None, None, 0.0)}
    one = spark.createDataFrame([("PV_open_circuit__voltage", " spin-coating ", None)], "a string, b string, c string")
    state = I.choice_state(F.col("b"), {"solution": ["spin-coating", "blade"], "vapour": ["evaporat\\w*"]})
    r = one.select(I.display_token(F.col("a")).alias("t"), I.context_label(["b", "c"]).alias("l"), state.alias("s"), I.choice_state(F.col("c"), {}).alias("n")).first()
    assert tuple(r) == ("open circuit voltage", "spin-coating | unspecified", "solution", "not_reported")
