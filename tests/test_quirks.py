"""Hand-made frames for edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from visitloom.functions import scalar as fn
from visitloom.operators import (
    cohort,
    evaluate,
    folds,
    labels,
    longitudinal,
    screen,
    shape,
    vectors,
)
from visitloom.sources import contract, files, records


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture()
def visits(spark):
    # patient 1: month 0 and 12 and 24; patient 2: one visit; patient 3: NULL score
    return spark.createDataFrame(
        [
            ("1_0", 1, 0, 5, "On"),
            ("1_12", 1, 12, 11, None),
            ("1_24", 1, 24, 30, "Off"),
            ("2_0", 2, 0, 3, "On"),
            ("3_0", 3, 0, None, None),
            ("3_6", 3, 6, 10, "Off"),
        ],
        "visit_id string, patient_id bigint, visit_month int, updrs_1 int, med string",
    )


@pytest.fixture()
def scores(visits):
    return visits.withColumn("target", F.lit("updrs_1")).withColumnRenamed("updrs_1", "score")


def test_null_score_falls_to_the_worst_class(visits):
    got = visits.select("visit_id", fn.severity("updrs_1", "updrs_1"), fn.binary_severity("updrs_1", "updrs_1"))
    assert dict((r[0], (r[1], r[2])) for r in got.collect()) == {
        "1_0": ("mild", 0), "1_12": ("moderate", 1), "1_24": ("severe", 1),
        "2_0": ("mild", 0), "3_0": ("severe", 1), "3_6": ("mild", 0),
    }


def test_future_label_sees_later_visits_and_window_label_does_not(scores):
    lab = labels.visit_labels(scores.where("patient_id = 1 and visit_month in (0, 24)"))
    assert rows(labels.future_label(lab).select("visit_id", "max_cat")) == [("1_0", 1)]
    assert rows(labels.window_label(lab).select("visit_id", "max_cat")) == [("1_0", 0)]


def test_wide_labels_equal_the_long_ones(visits, scores):
    lab = labels.visit_labels(scores)
    for whole, long in ((True, labels.future_label(lab)), (False, labels.window_label(lab))):
        wide = labels.patient_labels(visits, ["updrs_1"], whole_history=whole)
        keep = ("visit_id", "target", "cat", "max_cat")
        assert rows(wide.select(*keep), "visit_id") == rows(long.select(*keep), "visit_id")


def test_peptide_only_visits_are_dropped(spark):
    prot = spark.createDataFrame([("a", "P1", 2.0)], "visit_id string, UniProt string, NPX double")
    pept = spark.createDataFrame(
        [("a", "P1", "PEP", 1.0), ("b", "P1", "PEP", 1.0), ("a", None, "PEP", 4.0)],
        "visit_id string, UniProt string, Peptide string, PeptideAbundance double",
    )
    assert rows(shape.long_features(prot, pept).select("visit_id", "feature"), "feature") == [
        ("a", "P1"), ("a", "PEP_P1"),
    ]


def test_protein_of_a_modified_peptide(spark):
    df = spark.createDataFrame([("C(UniMod_4)K_P00734",), ("P00734",)], "feature string")
    got = df.select(fn.protein_of("feature"), fn.protein_of("feature", legacy=True))
    assert rows(got) == [("P00734", "4)K"), ("P00734", "P00734")]


def test_medication_is_checked_per_row(spark):
    df = spark.createDataFrame([("On",), ("Off",), (None,), ("Maybe",)], "med string")
    got = labels.check_medication(df, "med")
    assert [tuple(r) for r in got.collect()] == [
        ("On", 1, 0, True), ("Off", 0, 0, True), (None, 0, 1, True), ("Maybe", 0, 0, False),
    ]
    with pytest.raises(Exception, match="invalid medication state"):
        labels.require_medication(df, "med").collect()


def test_pivot_rejects_a_duplicate_cell(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "v string, f string, value double")
    with pytest.raises(Exception, match="duplicate"):
        shape.pivot_unique(df, ["v"], "f", "value", ["x"]).collect()


def test_conform_fills_drops_and_orders(spark):
    visits = spark.createDataFrame([("a", "t"), ("b", "t")], "visit_id string, target string")
    wanted = spark.createDataFrame([("t", 0, "x"), ("t", 1, "y")], "target string, pos int, feature string")
    feats = spark.createDataFrame([("a", "y", 3.0), ("a", "other", 9.0)], "visit_id string, feature string, value double")
    got = shape.conform(visits, wanted, feats).select("visit_id", "pos", "value")
    assert rows(got, "visit_id", "pos") == [("a", 0, 0.0), ("a", 1, 3.0), ("b", 0, 0.0), ("b", 1, 0.0)]


def test_vector_is_an_allow_list(spark):
    visits = spark.createDataFrame([("a", 6, 1, 0), ("b", 0, 0, 4)], "visit_id string, visit_month int, label int, kfold int")
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z"), (3, "w")], "pos int, feature string")
    feats = spark.createDataFrame(
        [("a", "z", 3.0), ("a", "x", 1.0), ("a", "label", 7.0)], "visit_id string, feature string, value double"
    )
    got = {r[0]: list(r[1]) for r in vectors.feature_vectors(visits, feats, names, ["visit_month"]).select("visit_id", "features").collect()}
    assert got == {"a": [6.0, 1.0, 0.0, 3.0, 0.0], "b": [0.0, 0.0, 0.0, 0.0, 0.0]}


def test_bins_of_a_constant_and_the_minimum(spark):
    df = spark.createDataFrame([("c", 5), ("c", 5), ("d", 0), ("d", 5), ("d", 10)], "target string, x int")
    got = folds.equal_width_bins(df, "x", ["target"], 2)
    assert sorted(tuple(r) for r in got.select("target", "x", "bin").collect()) == [
        ("c", 5, 0), ("c", 5, 0), ("d", 0, 0), ("d", 5, 0), ("d", 10, 1),
    ]


def test_folds_are_even_per_class(spark):
    df = spark.range(997).select(
        F.col("id").cast("string").alias("visit_id"), F.lit("t").alias("target"), (F.col("id") % 7).cast("int").alias("score")
    )
    got = folds.binned_folds(df).groupBy("score", "kfold").count().groupBy("score").agg(
        (F.max("count") - F.min("count")).alias("spread")
    )
    assert max(r["spread"] for r in got.collect()) <= 1
    sizes = [r["count"] for r in folds.binned_folds(df).groupBy("kfold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("visit_id"), F.lit("t").alias("target"), (F.col("id") % 5).cast("int").alias("score")
    )
    a = rows(folds.binned_folds(df.repartition(1)).select("visit_id", "kfold"), "visit_id")
    b = rows(folds.binned_folds(df.repartition(13)).select("visit_id", "kfold"), "visit_id")
    assert a == b


def test_single_visit_patients_have_no_pairs_and_count_as_large_change(scores):
    pairs = longitudinal.pair_deltas(scores)
    assert rows(pairs.where("patient_id = 2")) == []
    assert rows(pairs.where("patient_id = 1").select("visit_month", "visit_month_diff", "score_diff"), "visit_month", "visit_month_diff") == [
        (0, 12, 6), (0, 24, 25), (12, -12, -6), (12, 12, 19), (24, -24, -25), (24, -12, -19),
    ]
    flags = dict((r["patient_id"], r["large_diff"]) for r in longitudinal.large_change_flags(scores).collect())
    assert flags[2] == 1


def test_feature_deltas_need_both_visits(spark, visits):
    feats = spark.createDataFrame(
        [("1_0", "x", 5.0), ("1_12", "y", 2.0), ("2_0", "x", 1.0)], "visit_id string, feature string, value double"
    )
    got = rows(longitudinal.feature_deltas(feats, visits), "feature")
    assert got == [(1, "x", -5.0, None, None), (1, "y", 2.0, None, None)]


def test_feature_range_counts_missing_as_zero(spark):
    feats = spark.createDataFrame(
        [(1, "a", "x", 5.0), (1, "b", "x", 3.0), (1, "a", "y", 4.0)], "patient_id int, visit_id string, feature string, value double"
    )
    sampled = spark.createDataFrame([(1, "a"), (1, "b")], "patient_id int, visit_id string")
    assert rows(cohort.feature_range(feats, sampled), "feature") == [(1, "x", 5.0, 3.0), (1, "y", 4.0, 0.0)]


def test_change_from_first_is_null_without_a_baseline(scores):
    got = dict((r["visit_id"], r["change"]) for r in longitudinal.change_from_first(scores).collect())
    assert got["1_24"] == 25 and got["3_6"] is None


def test_constant_feature_has_no_correlation(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "visit_id string, y int")
    feats = spark.createDataFrame(
        [("a", "k", 2.0), ("b", "k", 2.0), ("c", "k", 2.0), ("b", "x", 4.0)], "visit_id string, feature string, value double"
    )
    got = dict((r["feature"], r["r"]) for r in screen.target_correlations(feats, v, ["y"]).collect())
    assert got["k"] is None and got["x"] == pytest.approx(1.0)


def test_metrics_without_cases_are_null(spark):
    df = spark.createDataFrame([("t", 0, 0), ("t", 0, 0)], "target string, label int, pred int")
    got = evaluate.classification_metrics(df, ["target"]).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (1.0, None, None, None)


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("t", 0, 0.1), ("t", 1, 0.9)], "target string, label int, p double")
    assert evaluate.score_auc(df, ["target"]).first()["auc"] == pytest.approx(0.875)


def test_threshold_boundary_is_inclusive(spark):
    step = 1.0 / 99
    df = spark.createDataFrame([("t", 1, 37 * step), ("t", 0, 0.0), ("t", 1, 1.0)], "target string, label int, p double")
    got = {round(r["threshold"] * 99): r["recall"] for r in evaluate.threshold_sweep(df, ["target"]).collect()}
    assert got[37] == 1.0 and got[38] == 0.5 and got[99] == 0.5


def test_smape_skips_zero_over_zero(spark):
    df = spark.createDataFrame([("t", 0.0, 0.0), ("t", 1.0, 3.0)], "target string, y double, p double")
    assert evaluate.regression_metrics(df, ["target"], "y", "p").first()["smape"] == pytest.approx(1.0)


def test_tied_best_threshold_is_the_lowest(spark):
    df = spark.createDataFrame([("t", 0.2, 0.5), ("t", 0.1, 0.5), ("t", 0.3, None)], "target string, threshold double, f1 double")
    assert evaluate.best_threshold(df, ["target"]).first()["threshold"] == 0.1


def test_records_plain_double_encoded_and_corrupt(spark, tmp_path):
    (tmp_path / "plain.json").write_text('{"patient_id": 7, "visit_month": 3, "P1": 2.5, "med": "On"}')
    (tmp_path / "twice.json").write_text('"{\\"patient_id\\": 8, \\"visit_month\\": 0, \\"visit_id\\": \\"given\\", \\"P1\\": 1}"')
    (tmp_path / "bad.json").write_text("{not json")
    read = records.read_records(spark, str(tmp_path))
    assert read.where("is_corrupt").count() == 1
    v = records.visit_fields(read.where("not is_corrupt"))
    assert rows(v.select("visit_id", "patient_id", "visit_month", "med"), "patient_id") == [
        ("7_3", 7, 3, "On"), ("given", 8, 0, None),
    ]
    assert rows(records.feature_rows(v), "visit_id") == [("7_3", "P1", 2.5), ("given", "P1", 1.0)]


def test_contract_file_as_json_or_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('["visit_month", "P1"]')
    (tmp_path / "b.txt").write_text("visit_month\nP1\n")
    for name in ("a.txt", "b.txt"):
        got = contract.read_contract(spark, str(tmp_path / name), "updrs_1")
        assert rows(got, "pos") == [("updrs_1", 0, "visit_month"), ("updrs_1", 1, "P1")]


def test_positional_header_names_both_sides(spark):
    df = spark.createDataFrame([(1, 2)], "_c0 int, _c1 int")
    with pytest.raises(ValueError, match="2 columns.*contract has 1"):
        files.name_by_position(df, ["only"])


def test_forecast_grid_shape(spark):
    req = spark.createDataFrame([("3342_0", "updrs_1", 0)], "visit_id string, updrs_test string, group_key int")
    got = [r["prediction_id"] for r in longitudinal.forecast_grid(req).orderBy("plus_months").collect()]
    assert got == [f"3342_0_updrs_1_plus_{m}_months" for m in (0, 6, 12, 24)]


def test_pair_products_names_in_order(spark):
    f = spark.createDataFrame([("a", "y", 3.0), ("a", "x", 2.0), ("a", "z", 0.5), ("b", "x", 1.0)], "visit_id string, feature string, value double")
    assert rows(shape.pair_products(f), "feature") == [("a", "x_y", 6.0), ("a", "x_z", 1.0), ("a", "y_z", 1.5)]


def test_pruning_leaves_no_high_pair(spark):
    m = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.1), ("c", "d", 0.76), ("a", "d", 0.0), ("b", "d", None)],
        "feature_a string, feature_b string, r double",
    )
    kept = set(screen.prune_correlated(m))
    left = [r for r in m.collect() if r["feature_a"] in kept and r["feature_b"] in kept and (r["r"] or 0) >= 0.75]
    assert left == [] and kept
