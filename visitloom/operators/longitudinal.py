"""Deltas, baselines and horizons over the visits of a patient.

A visits frame has one row per patient and month, so the visits of a patient
number at most the months of the calendar; windows over a patient and pairs of
its visits are bounded by that, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.config import DELTA_MONTHS, FORECAST_MONTHS, SCORED_TARGETS
from visitloom.functions.scalar import visit_key
from visitloom.operators.cohort import first_last
from visitloom.operators.labels import per_patient
from visitloom.operators.ranking import quantiles
from visitloom.session import materialize


def visit_pairs(visits: DataFrame) -> DataFrame:
    """Each visit with every other month of its patient.

    The partner side is the patient's list of months, gathered by one window,
    so the visits are shuffled once and not joined with themselves.
    """
    months = F.collect_set("visit_month").over(per_patient())
    others = F.array_remove("_months", F.col("visit_month"))
    return (
        visits.withColumn("_months", months)
        .select("*", F.explode(others).alias("visit_month_2"))
        .drop("_months")
        .withColumn("visit_month_diff", F.col("visit_month_2") - F.col("visit_month"))
    )


def pair_deltas(scores: DataFrame) -> DataFrame:
    """Score change from each visit to every other visit of the patient.

    ``scores`` has (visit_id, patient_id, visit_month, target, score). A month
    has one visit, so the mean score of a partner month is that visit's score.
    Single-visit patients give no row.
    """
    others = F.collect_list(F.struct("visit_month", "score")).over(per_patient("target"))
    known = scores.where("score is not null").withColumn("_all", others)
    pairs = known.select(
        "visit_id", "patient_id", "visit_month", "target", "score", F.inline("_all").alias("_m", "_s")
    ).where(F.col("_m") != F.col("visit_month"))
    return pairs.select(
        "visit_id",
        "patient_id",
        "visit_month",
        "target",
        "score",
        (F.col("_m") - F.col("visit_month")).alias("visit_month_diff"),
        (F.col("_s") - F.col("score")).alias("score_diff"),
    )


def change_from_first(scores: DataFrame) -> DataFrame:
    """Score minus the month-0 score; NULL where month 0 has none."""
    base = F.max(F.when(F.col("visit_month") == 0, F.col("score"))).over(per_patient("target"))
    return scores.withColumn("change", F.col("score") - base)


def edge_visit(visits: DataFrame, columns: list[str], last: bool = False) -> DataFrame:
    """The whole first (or last) visit of each patient, as an aggregate."""
    pick = F.max_by if last else F.min_by
    return (
        visits.groupBy("patient_id")
        .agg(pick(F.struct(*columns), F.struct("visit_month", "visit_id")).alias("_v"))
        .select("patient_id", "_v.*")
    )


def score_by_month(scores: DataFrame, months: list[int]) -> DataFrame:
    """Month-0 visits with the patient's score at each listed month."""
    cells = scores.where(F.col("visit_month").isin(months))
    wide = cells.groupBy("patient_id", "target").pivot("visit_month", months).agg(F.max("score"))
    wide = wide.select(
        "patient_id", "target", *[F.col(str(m)).alias(f"score_{m}") for m in months]
    )
    first = scores.where("visit_month = 0").select("visit_id", "patient_id", "target")
    return first.join(wide, ["patient_id", "target"], "left").drop("patient_id")


def feature_deltas(
    features: DataFrame, visits: DataFrame, months: tuple[int, ...] = DELTA_MONTHS
) -> DataFrame:
    """(patient_id, feature, d12, d18, d24): value at the month minus month 0.

    Both sides count a missing value as 0. A patient without a sampled month-0
    visit has no row, and a month without a sampled visit gives NULL. The
    sampled months of a patient ride along with its features, so this is one
    aggregate and not a chain of joins.
    """
    wanted = visits.where(F.col("visit_month").isin(0, *months)).select(
        "visit_id", "patient_id", "visit_month"
    )
    rows = wanted.join(features.select("visit_id", "feature", "value"), "visit_id")
    at = lambda m: F.max(F.when(F.col("visit_month") == m, F.col("value")))
    per_feature = rows.groupBy("patient_id", "feature").agg(
        *[at(m).alias(f"_v{m}") for m in (0, *months)], F.collect_set("visit_month").alias("_m")
    )
    # at most features x patients rows; a patient's features are a contract at most
    sampled = F.flatten(F.collect_set("_m").over(per_patient()))
    filled = per_feature.withColumn("_sampled", F.array_distinct(sampled))
    diff = lambda m: F.when(
        F.array_contains("_sampled", m),
        F.coalesce(f"_v{m}", F.lit(0.0)) - F.coalesce("_v0", F.lit(0.0)),
    )
    return filled.where(
        F.array_contains("_sampled", 0) & (F.size("_sampled") > 1)
    ).select("patient_id", "feature", *[diff(m).alias(f"d{m}") for m in months])


def delta_extremes(deltas: DataFrame, months: tuple[int, ...] = DELTA_MONTHS) -> DataFrame:
    cols = [f"d{m}" for m in months]
    return deltas.select(
        "patient_id",
        "feature",
        F.greatest(*cols).alias("max_diff"),
        F.least(*cols).alias("min_diff"),
    )


def monthly_rate(scores: DataFrame) -> DataFrame:
    """Average monthly change from the first to the last known score."""
    ends = first_last(scores)
    return ends.withColumn(
        "avg_monthly_diff",
        F.try_divide(
            (F.col("last_score") - F.col("first_score")).cast("double"),
            F.col("last_month") - F.col("first_month"),
        ),
    )


def large_change_flags(scores: DataFrame, cut: float = 0.66) -> DataFrame:
    """1 where the rate (or the last score) is above the target's quantile.

    A patient with one visit has no rate and counts as 1.
    """
    rates = materialize(monthly_rate(scores), "rates")
    q_rate = quantiles(rates, ["target"], "avg_monthly_diff", {"_q_rate": cut})
    q_last = quantiles(rates, ["target"], "last_score", {"_q_last": cut})
    edges = q_rate.join(q_last, "target")
    flag = lambda x, q: F.when(F.col(x) <= F.col(q), 0).otherwise(1)
    return rates.join(F.broadcast(edges), "target").select(
        "patient_id",
        "target",
        flag("avg_monthly_diff", "_q_rate").alias("large_diff"),
        flag("last_score", "_q_last").alias("large_last_val"),
    )


def forecast_grid(requests: DataFrame, months: tuple[int, ...] = FORECAST_MONTHS) -> DataFrame:
    """One row per request and horizon with its prediction id.

    ``requests`` has (visit_id, updrs_test, group_key).
    """
    grid = requests.select(
        "visit_id", "updrs_test", "group_key", F.explode(F.array(*[F.lit(m) for m in months])).alias("_m")
    )
    made = F.concat(
        "visit_id", F.lit("_"), "updrs_test", F.lit("_plus_"), F.col("_m").cast("string"), F.lit("_months")
    )
    return grid.select(
        made.alias("prediction_id"), F.lit(0).alias("rating"), "group_key", F.col("_m").alias("plus_months")
    )


def assemble_predictions(scored: DataFrame) -> DataFrame:
    """Visits with targets 1 and 2, and target 3 where it exists.

    An inner and a left join on one key, done as one aggregate per visit.
    """
    cols = []
    for t in SCORED_TARGETS:
        here = F.col("target") == t
        cols += [
            F.max(F.when(here, F.col("label"))).alias(f"{t}_cat"),
            F.max(F.when(here, F.col("pred"))).alias(f"{t}_pred"),
        ]
    first, second = SCORED_TARGETS[:2]
    return (
        scored.groupBy("visit_id")
        .agg(*cols)
        .where(F.col(f"{first}_pred").isNotNull() & F.col(f"{second}_pred").isNotNull())
    )


def with_visit_key(df: DataFrame) -> DataFrame:
    given = F.col("visit_id") if "visit_id" in df.columns else None
    return df.withColumn("visit_id", visit_key("patient_id", "visit_month", given))
