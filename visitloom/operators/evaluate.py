"""Metrics of scored rows.

Scored rows have (target, label, p) or (target, label, pred). Every metric is
one aggregate over counts; ranked metrics work on distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scalar import smape_term
from visitloom.operators.ranking import running


def _counts(label: str, pred: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(pred)
    return {
        "tp": F.count_if((y == 1) & (p == 1)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "tn": F.count_if((y == 0) & (p == 0)),
        "fn": F.count_if((y == 1) & (p == 0)),
    }


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": F.try_divide(2 * precision * recall, precision + recall),
    }


def confusion(df: DataFrame, group: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    counts = _counts(label, pred)
    return df.groupBy(*group).agg(*[c.alias(n) for n, c in counts.items()])


def classification_metrics(
    df: DataFrame, group: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Accuracy, precision, recall and F1; NULL where a rate has no cases."""
    c = confusion(df, group, label, pred)
    return c.select(*group, *[e.alias(n) for n, e in _rates().items()])


def class_report(df: DataFrame, group: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    c = confusion(df, group)
    one = F.struct(
        F.lit(1).alias("label"),
        F.col("tp").alias("hit"),
        (F.col("tp") + F.col("fp")).alias("called"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )
    zero = F.struct(
        F.lit(0).alias("label"),
        F.col("tn").alias("hit"),
        (F.col("tn") + F.col("fn")).alias("called"),
        (F.col("tn") + F.col("fp")).alias("support"),
    )
    rows = c.select(*group, F.inline(F.array(zero, one)))
    precision, recall = ratio(F.col("hit"), F.col("called")), ratio(F.col("hit"), F.col("support"))
    return rows.select(
        *group,
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        "support",
    )


def hard_auc(df: DataFrame, group: list[str]) -> DataFrame:
    """AUC of 0/1 predictions: the mean of both classes' recall."""
    c = confusion(df, group)
    tpr = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.select(*group, ((tpr + tnr) / 2).alias("auc"))


def score_auc(df: DataFrame, group: list[str], score: str = "p", buckets: int = 4096) -> DataFrame:
    """AUC of probabilities; a tie of a positive and a negative counts half.

    Rows fold into distinct scores with their class counts; each score then
    needs the negatives below it, a running sum over score buckets.
    """
    cells = df.groupBy(*group, F.col(score).alias("_s")).agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg")
    )
    bucket = F.floor(F.col("_s") * buckets).cast("int")
    placed = running(cells, group, ["_s"], {"_neg": "_below"}, bucket)
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return placed.groupBy(*group).agg(F.try_divide(won, pairs).alias("auc"))


def threshold_sweep(df: DataFrame, group: list[str], points: int = 100, score: str = "p") -> DataFrame:
    """Metrics at ``points`` thresholds from 0 to 1, called with ``>=``.

    A row is counted once, in the highest threshold it reaches; the counts of
    each threshold are running sums over at most ``points`` rows per group. So
    the rows are not multiplied by the thresholds.
    """
    step = 1.0 / (points - 1)
    at = lambda i: F.when(i == points - 1, F.lit(1.0)).otherwise(i * F.lit(step))
    guess = F.least(F.floor(F.col(score) * (points - 1)).cast("int"), F.lit(points - 1))
    up = (guess + 1 <= points - 1) & (F.col(score) >= at(guess + 1))
    down = F.col(score) < at(guess)
    reached = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    cells = df.groupBy(*group, reached.alias("_i")).agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg")
    )
    # one row per group with at most ``points`` entries, laid out over the grid
    held = cells.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.struct("_pos", "_neg")))).alias("_m")
    )
    grid = held.select(*group, "_m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    cell = F.try_element_at(F.col("_m"), F.col("_i"))
    full = grid.select(
        *group,
        "_i",
        F.coalesce(cell["_pos"], F.lit(0)).alias("_pos"),
        F.coalesce(cell["_neg"], F.lit(0)).alias("_neg"),
    )
    from_here = Window.partitionBy(*group).orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(*group)
    counted = full.select(
        *group,
        at(F.col("_i")).alias("threshold"),
        F.sum("_pos").over(from_here).alias("tp"),
        F.sum("_neg").over(from_here).alias("fp"),
        (F.sum("_pos").over(everyone) - F.sum("_pos").over(from_here)).alias("fn"),
        (F.sum("_neg").over(everyone) - F.sum("_neg").over(from_here)).alias("tn"),
    )
    return counted.select(*group, "threshold", *[e.alias(n) for n, e in _rates().items()])


def best_threshold(sweep: DataFrame, group: list[str], metric: str = "f1") -> DataFrame:
    """The threshold with the highest metric, the lowest one on ties."""
    return sweep.where(F.col(metric).isNotNull()).groupBy(*group).agg(
        F.max(metric).alias(f"best_{metric}"),
        F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("threshold"),
    )


def regression_metrics(df: DataFrame, group: list[str], truth: str, pred: str) -> DataFrame:
    """MSE, R2 and SMAPE as percent (2 places) and as fraction."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    n = F.count(F.lit(1))
    sse = F.sum((p - t) * (p - t))
    sst = F.sum(t * t) - F.sum(t) * F.sum(t) / n
    frac = F.avg(smape_term(t, p))
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*group).agg(
        (sse / n).alias("mse"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        F.round(frac * 100, 2).alias("smape_pct"),
        frac.alias("smape"),
    )


def residual_stats(df: DataFrame, group: list[str], truth: str, pred: str) -> DataFrame:
    r = F.col(truth).cast("double") - F.col(pred)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("mean_residual"),
        F.min(r).alias("min_residual"),
        F.max(r).alias("max_residual"),
        F.stddev_pop(r).alias("std_residual"),
    )


def winner(df: DataFrame, probabilities: str, classes: list[str]) -> DataFrame:
    """Label and probability of the most likely class; all probabilities kept.

    The first class wins a tie.
    """
    p = F.col(probabilities)
    best = F.array_max(p)
    names = F.array(*[F.lit(c) for c in classes])
    return df.select(
        "*",
        F.element_at(names, F.array_position(p, best).cast("int")).alias("predicted_label"),
        best.alias("probability"),
        F.array_join(F.transform(p, lambda x: F.round(x, 6).cast("string")), ",").alias("probabilities"),
        F.array_join(names, ",").alias("labels"),
    )


def class_weights(df: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """Weight of the positive class: negatives over positives."""
    return df.groupBy(*group).agg(
        ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("pos_weight")
    )
