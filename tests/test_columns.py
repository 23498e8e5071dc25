"""Columns that may feed a model, and the best column by hints."""

from granary.functions import columns as C

NAMES = ["Ref_DOI_number", "Cell_area_measured", "JV_default_PCE", "PCE_MODEL_oof_predicted_PCE", "Stability_T80", "_evidence_x", "Champion_flag", "ETL_stack_sequence"]


def test_nothing_gives_the_target_away():
    assert C.feature_columns(NAMES, "JV_default_PCE", "stability_design") == ["Cell_area_measured", "ETL_stack_sequence"]
    assert C.feature_columns(NAMES, "JV_default_PCE", "pce") == ["Cell_area_measured", "PCE_MODEL_oof_predicted_PCE", "ETL_stack_sequence"]
    assert [C.leakage_reason(n, "JV_default_PCE", "pce") for n in NAMES[:6]] == ["administrative", None, "target", None, "outcome", "administrative"]


def test_best_column(spark):
    df = spark.createDataFrame([(1, None, 2, 3), (None, None, 2, 3)], "Aging_temperature int, Test_temperature int, annealing_temperature int, Stability_test_temperature int")
    assert C.best_column(df, ["annealing temperature"], []) == "annealing_temperature"
    assert C.best_column(df, [], ["temperature"]) == "Stability_test_temperature"
    assert C.best_column(df.drop("Stability_test_temperature"), [], ["temperature"]) == "Aging_temperature"
    assert C.best_column(df, [], ["humidity"]) is None
