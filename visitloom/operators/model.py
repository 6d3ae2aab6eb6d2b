"""Model fitting, cross-validation, sweeps and scoring with Spark ML.

Fits are driver loops over distributed jobs. Tables that feed several fits are
written once (``session.materialize``) and read back, so a lost executor costs
a re-read and not the whole lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import evaluate

_CLASSIFIERS = {"gbt": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression}
_REGRESSORS = {"gbt": GBTRegressor, "forest": RandomForestRegressor}


def classifier(kind: str, **params) -> Estimator:
    est = _CLASSIFIERS[kind](featuresCol="features", labelCol="label")
    if kind != "logistic":
        est = est.setSeed(42)
    return est.setParams(**params)


def regressor(kind: str, **params) -> Estimator:
    return _REGRESSORS[kind](featuresCol="features", labelCol="label").setSeed(42).setParams(**params)


# Bytes of rows that a task of a fit holds, and that fits side by side hold in all, a number of 8 bytes a position.
TASK_BYTES = 128_000_000
FIT_BYTES = 2_000_000_000


def for_fits(table: DataFrame, width: int, key: str = "visit_id") -> tuple[DataFrame, int]:
    """A written table dealt anew for fits that hold its vectors in memory, and the fits to run side by side.

    Sparse vectors are small on disk, so a scan's task may bring a hundred times its
    bytes. Trees keep a number for each position of a row: a task gets as many rows as
    ``TASK_BYTES`` hold. A table that fits into one task stays as it is.
    """
    held = 8 * width * table.count()
    if held > TASK_BYTES:
        parts = max(-(-held // TASK_BYTES), table.sparkSession.sparkContext.defaultParallelism)
        table = table.repartition(parts, key)
    return table, max(1, FIT_BYTES // max(1, held))


def probability(df: DataFrame, column: str = "probability") -> DataFrame:
    """Probability of class 1 as ``p``, and the hard call as ``pred``."""
    return df.withColumn("p", vector_to_array(F.col(column))[1]).withColumn(
        "pred", F.col("prediction").cast("int")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fold_predictions(
    table: DataFrame,
    make: Callable[[], Estimator],
    folds: list[int],
    keep: list[str],
    fold: str = "kfold",
    parallelism: int = 5,
) -> DataFrame:
    """Out-of-fold predictions: for each fold, fit on the others and score it."""

    def one(f: int) -> DataFrame:
        model = make().fit(table.where(F.col(fold) != f))
        scored = model.transform(table.where(F.col(fold) == f))
        if "probability" in scored.columns:
            scored = probability(scored).select(*keep, "label", "p", "pred", fold)
        else:
            scored = scored.select(*keep, "label", "prediction", fold)
        return scored

    spark = table.sparkSession
    with ThreadPool(min(parallelism, len(folds))) as pool:
        return _union(pool.map(inheritable_thread_target(spark)(one), folds))


def hard_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    """AUC of hard calls, accuracy, precision and recall of each group."""
    c = evaluate.confusion(preds, by)
    tpr = evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = evaluate.ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.select(
        *by,
        ((tpr + tnr) / 2).alias("auc"),
        evaluate.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("acc"),
        F.coalesce(evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("prec"),
        F.coalesce(tpr, F.lit(0.0)).alias("recall"),
    )


def cross_validate(
    table: DataFrame, make: Callable[[], Estimator], folds: list[int], group: list[str] | None = None, parallelism: int = 5
) -> DataFrame:
    """Per-fold AUC of hard calls, accuracy, precision and recall."""
    preds = fold_predictions(table, make, folds, group or [], parallelism=parallelism)
    return hard_metrics(preds, [*(group or []), "kfold"])


def mean_over_folds(per_fold: DataFrame, group: list[str]) -> DataFrame:
    return per_fold.groupBy(*group).agg(
        *[F.avg(m).alias(m) for m in ("auc", "acc", "prec", "recall")]
    )


def regression_cv(table: DataFrame, make: Callable[[], Estimator], folds: list[int], parallelism: int = 5) -> DataFrame:
    preds = fold_predictions(table, make, folds, [], parallelism=parallelism)
    return evaluate.regression_metrics(preds, ["kfold"], "label", "prediction")


def staged_boosting(
    train: DataFrame, validation: DataFrame, make: Callable[[int], Estimator], rounds: int = 100, patience: int = 50
):
    """The boosted model of the best round on ``validation``, and the loss of each round.

    ``make`` builds the estimator for a number of trees. The validation loss of every
    round counts until none of the next ``patience`` rounds is better than the best so
    far. The best prefix of the trees is the model: boosting with one seed makes the
    same first trees however many follow.
    """
    whole = make(rounds).fit(train)
    curve = list(whole.evaluateEachIteration(validation))
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            curve = curve[: i + 1]
            break
    return (whole if best + 1 == rounds else make(best + 1).fit(train)), curve


def importances(model, names: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted forest, as long as the contract."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    )


def pca_components(df: DataFrame, keys: list[str], share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Scores on the fewest components whose variance reaches ``share``.

    The covariance is as wide as the feature vector, never as long as the data.
    """
    scaler = StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True).fit(df)
    scaled = scaler.transform(df)
    width = len(scaler.mean)
    model = PCA(k=width, inputCol="_z", outputCol="_pc").fit(scaled)
    ratio = [float(x) for x in model.explainedVariance]
    total, k = 0.0, 0
    while k < width and total < share - 1e-12:
        total += ratio[k]
        k += 1
    scores = F.slice(vector_to_array("_pc"), 1, k)
    return model.transform(scaled).select(*keys, scores.alias("components")), ratio[:k]


def impute_from(
    known: DataFrame, unknown: DataFrame, inputs: list[str], target: str, estimator: Estimator
) -> DataFrame:
    """Fit on rows with a target, predict rows without; rounded half to even."""
    from pyspark.ml.functions import array_to_vector

    vec = array_to_vector(F.array(*[F.col(c).cast("double") for c in inputs]))
    model = estimator.fit(
        known.select(vec.alias("features"), F.col(target).cast("double").alias("label"))
    )
    out = model.transform(unknown.withColumn("features", vec))
    return out.withColumn(target, F.bround("prediction", 0).cast("int"))
