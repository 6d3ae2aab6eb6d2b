"""Queries that fit models. They have no SQL oracle; tests check their properties."""

import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR, N_FOLDS, SCORED_TARGETS
from visitloom.functions.scalar import map_codes, rounded, severity, sign_flag
from visitloom.operators import (
    balance,
    components,
    contributions,
    evaluate,
    forests,
    labels,
    longitudinal,
    model,
    scoring,
    screen,
    training,
    vectors,
)
from visitloom.plans.frames import scores
from visitloom.plans.registry import query
from visitloom.session import fresh_path, materialize
from visitloom.sources import clinic, contract, records
from visitloom.sources.files import table, version
from visitloom.streaming import score as stream

FOLDS = list(range(N_FOLDS))
FOREST = {"numTrees": 8, "maxDepth": 4}
_WRITTEN: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """A table or model of this session that several queries start from.

    It is built anew where the given tables have been rewritten since.
    """
    key, now = (spark.sparkContext.applicationId, sf_dir, name), version(spark, sf_dir)
    if key not in _WRITTEN or _WRITTEN[key][0] != now:
        _WRITTEN[key] = now, build()
    return _WRITTEN[key][1]


def stored_features(spark, sf) -> DataFrame:
    return _once(spark, sf, "features", lambda: materialize(clinic.features(spark, sf), "features"))


def stored_visits(spark, sf) -> DataFrame:
    return _once(spark, sf, "visits", lambda: materialize(clinic.visits(spark, sf), "visits"))


def feature_contract(spark, sf) -> DataFrame:
    """(pos, feature, kind): the measured names in order, written once."""

    def build():
        feats = stored_features(spark, sf)
        listed = contract.contract_of(feats, ["all"]).drop("target")
        kinds = feats.select("feature", "kind").distinct()
        return materialize(listed.join(kinds, "feature").select("pos", "feature", "kind"), "contract")

    return _once(spark, sf, "contract", build)


def vector_names(spark, sf) -> list[str]:
    """Names of the vector positions: as many as the contract has."""
    rows = feature_contract(spark, sf).orderBy("pos").select("feature").collect()
    return [*scoring.EXTRA, *[r[0] for r in rows]]


def sampled_visits(spark, sf) -> DataFrame:
    """Sampled visits with their totals, written once."""

    def build():
        return materialize(training.sampled_visits(stored_visits(spark, sf), stored_features(spark, sf)), "sampled-visits")

    return _once(spark, sf, "sampled", build)


def _vectors(spark, sf, rows: DataFrame, feats: DataFrame) -> DataFrame:
    """Visits with their vector and scores, written once."""
    vec = vectors.feature_vectors(scoring.add_dummies(rows), feats, feature_contract(spark, sf), scoring.EXTRA)
    return vec.drop("med_on", "med_unknown")


def visit_vectors(spark, sf) -> DataFrame:
    """Sampled visits with their vector and scores."""

    def build():
        feats = stored_features(spark, sf)
        return _vectors(spark, sf, training.sampled_visits(stored_visits(spark, sf), feats), feats)

    return _once(spark, sf, "vectors", build)


def early_vectors(spark, sf) -> DataFrame:
    """``visit_vectors`` of the first year; those of later visits aren't made for it."""
    if (spark.sparkContext.applicationId, sf, "vectors") in _WRITTEN:
        return visit_vectors(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)

    def build():
        rows = sampled_visits(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)
        return _vectors(spark, sf, rows, stored_features(spark, sf).join(rows.select("visit_id"), "visit_id", "left_semi"))

    return _once(spark, sf, "early-vectors", build)


def first_year(spark, sf, target: str) -> DataFrame:
    """Visits of the first year: vector, future label, fold and score of a target."""

    def build():
        index = training.index_of(sampled_visits(spark, sf), [target])
        labelled = labels.future_label(
            index.select("visit_id", "patient_id", "visit_month", "target", "score", "kfold",
                         map_codes("cat").alias("cat"))
        )
        rows = labelled.select("visit_id", "score", "kfold", F.col("max_cat").cast("double").alias("label"))
        vec = early_vectors(spark, sf)
        joined = vec.select("visit_id", "patient_id", "visit_month", "features").join(rows, "visit_id")
        return materialize(joined, f"first-year-{target}")

    return _once(spark, sf, f"first-year-{target}", build)


def _for_fits(spark, sf, table: DataFrame) -> tuple[DataFrame, int]:
    return model.for_fits(table, len(vector_names(spark, sf)))


def scoring_models(spark, sf) -> dict:
    """One fitted model per target on its first-year visits."""

    def fit(target):
        est = model.classifier("logistic", maxIter=20, regParam=0.05)
        return est.fit(first_year(spark, sf, target).select("features", "label"))

    return {t: _once(spark, sf, f"model-{t}", lambda t=t: fit(t)) for t in SCORED_TARGETS}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, rounded(c))
    return df


METRICS = ("auc", "acc", "prec", "recall")


@query("M02_principal_components")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    pcs, _ = model.pca_components(e, ["vec_id", "label"])
    return pcs.select("vec_id", "label", F.posexplode("components").alias("component", "value"))


@query("M02_feature_components")
def _(spark, sf):
    """Components of the measured features over the sampled visits that have a target's score."""
    names, lists = screen.listed(stored_features(spark, sf), "value")
    visits = stored_visits(spark, sf).select("visit_id", *SCORED_TARGETS)
    # a visit's values meet once, for all targets
    sampled = materialize(lists.join(visits, "visit_id"), "lists")
    parts = []
    for target in SCORED_TARGETS:
        own = sampled.where(F.col(target).isNotNull()).select("visit_id", F.col(target).alias("score"), "pos", "val")
        loadings, constant, _ = components.fit(own, len(names))
        if len(constant):
            parts.append(components.project(own, loadings, constant).withColumn("target", F.lit(target)))
    if not parts:
        return spark.createDataFrame([], "target string, visit_id string, score int, components array<double>")
    return model._union(parts).select("target", "visit_id", "score", "components")


@query("M06_forest_selection")
def _(spark, sf):
    names = vector_names(spark, sf)
    vec = visit_vectors(spark, sf)
    reg = vec.where("updrs_1 is not null").select("visit_id", "features", F.col("updrs_1").cast("double").alias("label"))
    flags = longitudinal.large_change_flags(
        scores(spark, sf, ["updrs_1"])
    ).select("patient_id", F.col("large_diff").cast("double").alias("label"))
    first = longitudinal.edge_visit(vec, ["visit_id", "features"])
    cls = first.join(flags, "patient_id").select("visit_id", "features", "label")
    out = []
    for kind, est, data in (
        ("regression", model.regressor("forest", **FOREST), reg),
        ("classification", model.classifier("forest", **FOREST), cls),
    ):
        fitted = est.fit(_for_fits(spark, sf, materialize(data, "selection"))[0])
        out.append(model.importances(fitted, names, spark).withColumn("kind", F.lit(kind)))
    kept = screen.above_mean(out[0].unionByName(out[1]), ["kind"])
    return kept.select("kind", "feature", "importance")


def _top_positions(spark, sf, n: int) -> list[tuple[str, int]]:
    """Top ``n`` vector positions by forest importance for the first score."""

    def build():
        names = vector_names(spark, sf)
        t = _for_fits(spark, sf, first_year(spark, sf, "updrs_1"))[0]
        t = t.select("features", F.col("score").cast("double").alias("label"))
        fitted = model.regressor("forest", **FOREST).fit(t)
        top = model.importances(fitted, names, spark).orderBy(F.desc("importance"), "feature").limit(10)
        return [(r[0], names.index(r[0])) for r in top.collect()]

    return _once(spark, sf, "top-positions", build)[:n]


@query("M07_forest_top_features")
def _(spark, sf):
    top = _top_positions(spark, sf, 10)
    return spark.createDataFrame(
        [(name, place + 1) for place, (name, _) in enumerate(top)], "feature string, place int"
    )


def _score_table(spark, sf) -> DataFrame:
    t = first_year(spark, sf, "updrs_1")
    return t.select("visit_id", "features", "kfold", F.col("score").cast("double").alias("label"))


def _binned(spark, sf, target: str) -> DataFrame:
    """First-year visits with the score as label, features binned, written once."""

    def build():
        rows = first_year(spark, sf, target).select("visit_id", "features", "kfold", F.col("score").alias("label"))
        return forests.binned(rows, "visit_id")

    return _once(spark, sf, f"binned-{target}", build)


def _subset_errors(spark, sf, target: str):
    data = _binned(spark, sf, target)
    return lambda subsets: forests.subset_errors(data, subsets, FOLDS, n_trees=3, max_depth=3)


def _stepwise(spark, sf):
    """Forward selection over every vector position, from the most important ones, written once."""

    def build():
        start = [i for _, i in _top_positions(spark, sf, 10)]
        others = range(len(vector_names(spark, sf)))
        return forests.forward_stepwise(start, others, _subset_errors(spark, sf, "updrs_1"))

    return _once(spark, sf, "stepwise", build)


@query("M08_forward_stepwise")
def _(spark, sf):
    names = vector_names(spark, sf)
    chosen, _, taken = _stepwise(spark, sf)
    errors = dict(taken)
    rows = [(names[i], place + 1, errors.get(i)) for place, i in enumerate(chosen)]
    return spark.createDataFrame(rows, "feature string, place int, smape double")


@query("M09_backward_stepwise")
def _(spark, sf):
    names, month = vector_names(spark, sf), scoring.EXTRA.index("visit_month")
    start = list(dict.fromkeys([month, *_stepwise(spark, sf)[0]]))
    kept, error = forests.backward_stepwise(start, [month], _subset_errors(spark, sf, "updrs_1"))
    return spark.createDataFrame([(names[i], error) for i in kept], "feature string, smape double")


@query("M10_impute_score")
def _(spark, sf):
    v = stored_visits(spark, sf)
    inputs = ["updrs_1", "updrs_2", "updrs_3"]
    usable = v.na.drop("any", subset=inputs)
    out = model.impute_from(
        usable.where("updrs_4 is not null"), usable.where("updrs_4 is null"), inputs, "updrs_4",
        model.regressor("forest", **FOREST),
    )
    return out.select("visit_id", "updrs_4")


@query("M11_impute_class")
def _(spark, sf):
    known = visit_vectors(spark, sf).na.drop("any", subset=["updrs_1", "updrs_2", "updrs_3"])
    wide = VectorAssembler(
        inputCols=["updrs_1", "updrs_2", "updrs_3", "features"], outputCol="all", handleInvalid="error"
    ).transform(known).select("visit_id", "updrs_4", F.col("all").alias("features"))
    train = wide.where("updrs_4 is not null").select(
        "visit_id", "features", sign_flag("updrs_4").cast("double").alias("label")
    )
    fitted = model.classifier("forest", **FOREST).fit(_for_fits(spark, sf, train)[0].select("features", "label"))
    out = fitted.transform(wide.where("updrs_4 is null"))
    return out.select("visit_id", F.col("prediction").cast("int").alias("updrs_4_pred"))


@query("M12_balance_classes")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") == 0).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    out = balance.smote(rows)
    return out.select("id", "label", "is_synthetic", "seed_id", "neighbor_id", "vec")


@query("M13_cross_validation")
def _(spark, sf):
    parts = []
    for target in SCORED_TARGETS:
        data, at_once = _for_fits(spark, sf, first_year(spark, sf, target))
        per_fold = model.cross_validate(data, lambda: model.classifier("forest", **FOREST), FOLDS, parallelism=at_once)
        parts.append(per_fold.withColumn("target", F.lit(target)))
    return _rounded(model.mean_over_folds(model._union(parts), ["target"]), *METRICS)


@query("M14_hold_out_fold")
def _(spark, sf):
    data = first_year(spark, sf, "updrs_1")
    train = data.where("kfold <> 0").select(
        F.col("visit_id").alias("id"), "label", "kfold", "features"
    )
    balanced = balance.smote(train, "features").select("id", "label", "features")
    balanced, _ = model.for_fits(materialize(balanced, "balanced"), len(vector_names(spark, sf)), "id")
    fitted = model.classifier("gbt", maxIter=5, maxDepth=3).fit(balanced.select("label", "features"))
    held = model.probability(fitted.transform(data.where("kfold = 0"))).select("visit_id", "label", "p")
    held = materialize(held.withColumn("target", F.lit("updrs_1")), "held-out")
    auc = evaluate.score_auc(held, ["target"])
    called = evaluate.classification_metrics(
        held.withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["target"]
    )
    return _rounded(auc.join(called, "target"), "auc", "accuracy", "precision", "recall", "f1")


# Settings of the sweep: the values of each parameter in turn, the others as in the base.
SWEEP_BASE = {"n_trees": 4, "max_depth": 4, "min_rows": 1, "subsample": 1.0, "colsample": 1.0, "pos_weight": 1.0}
SWEEP_GRID = {
    "max_depth": [2, 3, 4, 5, 6],
    "min_rows": [1, 3, 5, 7, 9],
    "pos_weight": [1.1, 1.3, 1.7, 2.0, 2.3],
    "subsample": [0.3, 0.5, 0.7, 0.9],
    "colsample": [0.3, 0.5, 0.7, 0.9],
}


def _labelled(spark, sf, target: str) -> DataFrame:
    """First-year visits with the future class as label, features binned, written once."""
    return _once(spark, sf, f"labelled-{target}", lambda: forests.binned(first_year(spark, sf, target), "visit_id"))


def _forest(width: int, fold: int, s: dict) -> list[forests.Tree]:
    """The trees of a setting, each on its own draw of the features."""
    rng = random.Random(42)
    n = max(1, round(s["colsample"] * width))
    return [
        forests.Tree(
            tuple(sorted(rng.sample(range(width), n))), fold, seed, s["max_depth"], s["min_rows"], s["subsample"], s["pos_weight"]
        )
        for seed in range(s["n_trees"])
    ]


def _swept(data: DataFrame, width: int, settings: list[dict], folds: list[int]) -> DataFrame:
    """(setting, kfold, label, p) of every row for every setting, out of fold; all trees grown together."""
    trees, members, names = [], [], []
    for i, setting in enumerate(settings):
        for fold in folds:
            own = _forest(width, fold, setting)
            members.append(list(range(len(trees), len(trees) + len(own))))
            trees += own
            names.append(i)
    grown = forests.grow(data, trees)
    setting = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("forest") + 1)
    return forests.predictions(data, grown, members).select(
        setting.alias("setting"), F.col("fold").alias("kfold"), F.col("label").cast("int").alias("label"),
        F.col("prediction").alias("p"), (F.col("prediction") >= 0.5).cast("int").alias("pred"),
    )


@query("M15_parameter_sweep")
def _(spark, sf):
    width = len(vector_names(spark, sf))
    items = [(param, v) for param, values in SWEEP_GRID.items() for v in values]
    named = spark.createDataFrame([(i, p, str(v)) for i, (p, v) in enumerate(items)], "setting int, param string, val string")
    parts = []
    for target in SCORED_TARGETS:
        swept = _swept(_labelled(spark, sf, target), width, [{**SWEEP_BASE, p: v} for p, v in items], FOLDS)
        per_fold = model.hard_metrics(swept, ["setting", "kfold"])
        parts.append(model.mean_over_folds(per_fold, ["setting"]).withColumn("target", F.lit(target)))
    out = model._union(parts).join(F.broadcast(named), "setting")
    return _rounded(out, *METRICS).select("target", "param", "val", *METRICS)


@query("M16_validation_curve")
def _(spark, sf):
    depths, quarters = list(range(1, 14)), [0, 1, 2, 3]
    # four folds of all rows, by the rows' hash
    data = materialize(_labelled(spark, sf, "updrs_1").withColumn("fold", F.pmod("row", F.lit(4)).cast("int")), "quarters")
    settings = [{**SWEEP_BASE, "n_trees": 3, "max_depth": d} for d in depths]
    swept = _swept(data, len(vector_names(spark, sf)), settings, quarters)
    curve = evaluate.score_auc(swept, ["setting", "kfold"]).groupBy((F.col("setting") + 1).alias("max_depth")).agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc")
    )
    return _rounded(curve, "mean_auc", "std_auc")


@query("M18_batch_scoring")
def _(spark, sf):
    out = scoring.score_targets(
        visit_vectors(spark, sf), scoring_models(spark, sf), ["visit_id", "patient_id", "visit_month"]
    )
    return _rounded(out, "p")


@query("M19_tree_contributions")
def _(spark, sf):
    data = first_year(spark, sf, "updrs_1")
    dealt, _ = _for_fits(spark, sf, data)
    fitted = model.classifier("forest", numTrees=5, maxDepth=4).fit(dealt.select("features", "label"))
    return contributions.tree_contributions(data, fitted, vector_names(spark, sf))


@query("M21_regression_cv")
def _(spark, sf):
    data, at_once = _for_fits(spark, sf, _score_table(spark, sf))
    forest = model.regression_cv(data, lambda: model.regressor("forest", **FOREST), FOLDS, at_once)
    boosted = model.regression_cv(data, lambda: model.regressor("gbt", maxIter=4, maxDepth=3), FOLDS, at_once)
    both = forest.withColumn("model", F.lit("forest")).unionByName(boosted.withColumn("model", F.lit("boosted")))
    return _rounded(both, "mse", "r2", "smape").select("model", "kfold", "mse", "r2", "smape", "smape_pct")


@query("M23_logistic_baseline")
def _(spark, sf):
    """Folds 1 to 4, each held out once; fold 0 is set aside and the training folds are balanced."""

    held = FOLDS[1:]

    def balanced(target):
        train = first_year(spark, sf, target).where("kfold <> 0").select(
            F.col("visit_id").alias("id"), "label", "kfold", "features"
        )
        return [(target, fold, rows) for fold, rows in zip(held, balance.smote_folds(train, "kfold", held, "features"))]

    def held_out(item):
        target, fold, rows = item
        fitted = model.classifier("logistic", maxIter=10).fit(materialize(rows.select("label", "features"), "balanced"))
        data = first_year(spark, sf, target).where(F.col("kfold") == fold)
        return model.probability(fitted.transform(data)).select(F.lit(target).alias("target"), "kfold", "label", "pred")

    with ThreadPool(6) as pool:
        items = [x for own in pool.map(inheritable_thread_target(spark)(balanced), SCORED_TARGETS) for x in own]
        preds = model._union(pool.map(inheritable_thread_target(spark)(held_out), items))
    per_fold = model.hard_metrics(preds, ["target", "kfold"])
    return _rounded(model.mean_over_folds(per_fold, ["target"]), *METRICS)


@query("M27_model_save_load")
def _(spark, sf):
    data = first_year(spark, sf, "updrs_3")
    fitted = Pipeline(stages=[model.classifier("logistic", maxIter=10)]).fit(data.select("features", "label"))
    path = fresh_path(spark, "model")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    before = model.probability(fitted.transform(data)).select("visit_id", F.col("p").alias("p_before"))
    after = model.probability(loaded.transform(data)).select("visit_id", F.col("p").alias("p_after"))
    return before.join(after, "visit_id")


@query("M29_prediction_report")
def _(spark, sf):
    early = visit_vectors(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)
    scored = scoring.score_targets(
        early, scoring_models(spark, sf), ["visit_id", "patient_id", "visit_month", *SCORED_TARGETS]
    )
    cats = {t: severity(t, t) for t in SCORED_TARGETS}
    known = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in SCORED_TARGETS]).isNotNull()
    cat = F.coalesce(*[F.when(F.col("target") == t, c) for t, c in cats.items()])
    rows = scored.where(known).select("visit_id", "target", cat.alias("label"), "pred")
    report = longitudinal.assemble_predictions(rows)
    info = early.select("visit_id", "patient_id", "visit_month", "updrs_1")
    return info.join(report, "visit_id")


@query("M30_early_stopping")
def _(spark, sf):
    """The validation loss of each round and the AUC of the best prefix of trees."""
    data = first_year(spark, sf, "updrs_1")
    train = materialize(data.where("kfold <> 4").select("visit_id", "features", "label"), "boosted")
    train, _ = _for_fits(spark, sf, train)
    held = materialize(data.where("kfold = 4").select("features", "label"), "held-out")
    fitted, curve = model.staged_boosting(
        train, held, lambda n: model.classifier("gbt", maxIter=n, maxDepth=3), rounds=60, patience=50
    )
    n_trees = fitted.getNumTrees
    auc = evaluate.score_auc(model.probability(fitted.transform(held)).withColumn("target", F.lit("updrs_1")), ["target"])
    rounds = spark.createDataFrame([("updrs_1", i + 1, float(loss)) for i, loss in enumerate(curve)], "target string, round int, loss double")
    return rounds.join(F.broadcast(auc), "target").select(
        "target", "round", rounded("loss").alias("loss"), (F.col("round") == n_trees).alias("is_best"),
        F.lit(n_trees).alias("n_trees"), rounded("auc").alias("auc"),
    )


@query("ST1_score_stream")
def _(spark, sf):
    arriving, sink, checkpoint = (fresh_path(spark, n) for n in ("arriving", "scored", "checkpoint"))
    visits = stored_visits(spark, sf).select("visit_id", "patient_id", "visit_month", "med")
    # the sampled visits
    records.write_records(visits, stored_features(spark, sf), arriving, "inner")
    scored = stream.score_stream(spark, arriving, feature_contract(spark, sf), scoring_models(spark, sf))
    stream.run_available(scored, sink, checkpoint)
    return _rounded(spark.read.schema(scored.schema).parquet(sink), "p")


