"""Properties of the queries that fit models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from visitloom.operators import contributions, evaluate, model
from visitloom.plans import models as plans
from visitloom.plans.metrics import with_squares
from visitloom.plans.frames import stored_proteins

Q = entry.queries()


def test_principal_components_reach_the_share(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    _, ratio = model.pca_components(e, ["vec_id"])
    assert sum(ratio) >= 0.95 - 1e-9 and sum(ratio[:-1]) < 0.95
    assert Q["M02_principal_components"](spark, sf).groupBy("vec_id").count().select("count").distinct().count() == 1


def test_pruned_features_hold_no_high_pair(spark, sf):
    kept = [r[0] for r in Q["M05_prune_correlated"](spark, sf).collect()]
    from visitloom.operators import screen

    m = screen.spearman_matrix(with_squares(stored_proteins(spark, sf)))
    left = m.where(F.col("feature_a").isin(kept) & F.col("feature_b").isin(kept) & (F.col("r") >= 0.75))
    assert left.count() == 0 and kept


def test_yeo_johnson_is_standardized(spark, sf):
    z = Q["M03_yeo_johnson_transform"](spark, sf)
    n = stored_proteins(spark, sf).select("visit_id").distinct().count()
    sums = z.groupBy("feature").agg(
        F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).alias("c"), F.max("zero_value").alias("z0")
    )
    for r in sums.collect():
        zeros = n - r["c"]
        assert (r["s"] + zeros * r["z0"]) / n == pytest.approx(0, abs=1e-4)
        assert (r["ss"] + zeros * r["z0"] ** 2) / n == pytest.approx(1, abs=1e-3)


def test_vectors_hold_no_label_fold_or_id(spark, sf):
    names = plans.vector_names(spark, sf)
    assert not {"label", "kfold", "visit_id", "patient_id", "updrs_1", "updrs_2", "updrs_3", "updrs_4"} & set(names)
    width = plans.visit_vectors(spark, sf).select(F.size(vector_to_array("features"))).distinct().collect()
    assert [r[0] for r in width] == [len(names)]


def test_cross_validation_scores_are_rates(spark, sf):
    for r in Q["M13_cross_validation"](spark, sf).collect():
        assert all(0 <= r[m] <= 1 for m in ("auc", "acc", "prec", "recall") if r[m] is not None)


def test_saved_model_scores_the_same(spark, sf):
    both = Q["M27_model_save_load"](spark, sf)
    assert both.where("p_before <> p_after").count() == 0


def test_report_has_one_row_per_early_visit(spark, sf):
    report = Q["M29_prediction_report"](spark, sf)
    assert report.count() == report.select("visit_id").distinct().count()
    assert report.where("visit_month > 12 or updrs_1_pred is null or updrs_2_pred is null").count() == 0


def test_stream_equals_batch(spark, sf):
    batch = Q["M18_batch_scoring"](spark, sf).select("visit_id", "target", "p", "pred")
    live = Q["ST1_score_stream"](spark, sf).select("visit_id", "target", "p", "pred")
    assert batch.count() == live.count() > 0
    joined = batch.join(live.select("visit_id", "target", F.col("p").alias("q"), F.col("pred").alias("qpred")), ["visit_id", "target"])
    assert joined.count() == batch.count()
    assert joined.where("abs(p - q) > 1e-6 or pred <> qpred").count() == 0


def test_tree_contributions_add_up(spark, sf):
    data = plans.first_year(spark, sf, "updrs_1")
    fitted = model.classifier("forest", numTrees=4, maxDepth=4).fit(data.select("features", "label"))
    trees = contributions.tree_table(fitted)
    scored = fitted.transform(data).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).toPandas()
    base, c = contributions.path_contributions(trees, np.stack(scored.x))
    want = np.stack(scored.p)[:, 1]
    assert np.allclose((base + c.sum(1)) / len(trees), want, atol=1e-9)
    top = Q["M19_tree_contributions"](spark, sf)
    assert top.groupBy("visit_id").count().where("count <> 10").count() == 0


def test_rounding_of_imputed_scores(spark, sf):
    out = Q["M10_impute_score"](spark, sf)
    v = plans.stored_visits(spark, sf).where("updrs_4 is null and updrs_1 is not null and updrs_2 is not null and updrs_3 is not null")
    assert out.count() == v.count() and out.where("updrs_4 is null").count() == 0


def test_stepwise_goes_through_every_feature(spark, sf):
    names = plans.vector_names(spark, sf)
    top = {r["feature"] for r in Q["M07_forest_top_features"](spark, sf).collect()}
    rows = sorted(Q["M08_forward_stepwise"](spark, sf).collect(), key=lambda r: r["place"])
    assert len(top) == 10 and {r["feature"] for r in rows[:10]} == top
    assert all(r["smape"] is None for r in rows[:10])
    taken = rows[10:]
    errors = [r["smape"] for r in taken]
    assert taken and errors == sorted(errors, reverse=True) and len(set(errors)) == len(errors)
    # one by one over all positions that are left, each tried alone
    chosen, best, error = [names.index(r["feature"]) for r in rows[:10]], float("inf"), plans._subset_errors(spark, sf, "updrs_1")
    first = [i for i in range(len(names)) if i not in chosen][:6]
    for i in first:
        here = float(error([[*chosen, i]])[0])
        if here < best:
            best, chosen = here, [*chosen, i]
    assert [names.index(r["feature"]) for r in taken if names.index(r["feature"]) in first] == chosen[10:]
    kept = [r["feature"] for r in Q["M09_backward_stepwise"](spark, sf).collect()]
    assert "visit_month" in kept and set(kept) <= {"visit_month"} | {r["feature"] for r in rows}


def test_sweeps_score_every_row_of_every_setting(spark, sf):
    sweep = Q["M15_parameter_sweep"](spark, sf).toPandas()
    assert len(sweep) == 3 * 23 and sweep.groupby(["target", "param", "val"]).size().eq(1).all()
    assert sweep[["auc", "acc"]].stack().between(0, 1).all()
    curve = Q["M16_validation_curve"](spark, sf).toPandas()
    assert sorted(curve.max_depth) == list(range(1, 14)) and curve.mean_auc.between(0, 1).all()
    data = plans._labelled(spark, sf, "updrs_1")
    settings = [{**plans.SWEEP_BASE, "max_depth": d} for d in (1, 2)]
    swept = plans._swept(data, len(plans.vector_names(spark, sf)), settings, plans.FOLDS)
    assert {r["setting"]: r["count"] for r in swept.groupBy("setting").count().collect()} == {0: data.count(), 1: data.count()}


def test_early_stopping_takes_the_least_loss(spark, sf):
    rows = Q["M30_early_stopping"](spark, sf).toPandas().sort_values("round")
    best = rows[rows.is_best]
    assert len(best) == 1 and best["round"].item() == rows.n_trees.iloc[0] and best.loss.item() == rows.loss.min()


def test_components_of_the_features(spark, sf):
    rows = Q["M02_feature_components"](spark, sf).toPandas()
    assert set(rows.target) == {"updrs_1", "updrs_2", "updrs_3"}
    for _, part in rows.groupby("target"):
        value = np.stack(part.components)
        assert part.visit_id.is_unique and np.allclose(value.mean(0), 0, atol=1e-6)
        cov = value.T @ value / len(value)
        assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-6) and (np.diff(np.diag(cov)) <= 1e-9).all()


def test_model_queries_without_an_oracle(spark, sf):
    known = plans.stored_visits(spark, sf)
    out = Q["M11_impute_class"](spark, sf).toPandas()
    assert out.visit_id.is_unique and set(out.updrs_4_pred) <= {0, 1} and 0 < len(out) < known.count()
    held = Q["M14_hold_out_fold"](spark, sf).first()
    assert 0 <= held["auc"] <= 1
    cv = Q["M21_regression_cv"](spark, sf).toPandas()
    assert sorted(zip(cv.model, cv.kfold)) == [(m, f) for m in ("boosted", "forest") for f in range(5)] and (cv.mse >= 0).all()
    base = Q["M23_logistic_baseline"](spark, sf).toPandas()
    assert sorted(base.target) == ["updrs_1", "updrs_2", "updrs_3"] and base.acc.between(0, 1).all()


def test_hard_auc_is_the_mean_recall(spark):
    df = spark.createDataFrame([("t", 1, 1), ("t", 1, 0), ("t", 0, 0), ("t", 0, 0)], "target string, label int, pred int")
    assert evaluate.hard_auc(df, ["target"]).first()["auc"] == 0.75
