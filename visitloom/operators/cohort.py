"""Cohort and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR
from visitloom.functions.scalar import pearson
from visitloom.operators.ranking import quantiles
from visitloom.session import materialize


def score_range(scores: DataFrame) -> DataFrame:
    """Per (patient, target): max, min, mean and range of the score."""
    return scores.groupBy("patient_id", "target").agg(
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.avg(F.col("score").cast("double")).alias("mean_score"),
        (F.max("score") - F.min("score")).alias("score_range"),
    )


def first_last(scores: DataFrame) -> DataFrame:
    """First and last known score by month per (patient, target)."""
    known = scores.where("score is not null")
    return known.groupBy("patient_id", "target").agg(
        F.min_by("score", "visit_month").alias("first_score"),
        F.max_by("score", "visit_month").alias("last_score"),
        F.min("visit_month").alias("first_month"),
        F.max("visit_month").alias("last_month"),
    )


def feature_range(features: DataFrame, sampled: DataFrame) -> DataFrame:
    """Max and min of every feature per patient, missing values counting as 0.

    ``features`` has (patient_id, visit_id, feature, value) and ``sampled`` the
    visits that have a sample. A feature absent from some visit of the patient
    reaches 0; a feature absent from all of them has no row.
    """
    n_visits = sampled.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_visits"))
    seen = features.groupBy("patient_id", "feature").agg(
        F.max("value").alias("_mx"), F.min("value").alias("_mn"), F.count(F.lit(1)).alias("_n")
    )
    full = F.col("_n") == F.col("_visits")
    return seen.join(n_visits, "patient_id").select(
        "patient_id",
        "feature",
        F.when(full, F.col("_mx")).otherwise(F.greatest("_mx", F.lit(0.0))).alias("max_value"),
        F.when(full, F.col("_mn")).otherwise(F.least("_mn", F.lit(0.0))).alias("min_value"),
    )


def visits_per_patient(visits: DataFrame) -> DataFrame:
    return visits.groupBy("patient_id").agg(F.countDistinct("visit_month").alias("num_visits"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_counts_table(df: DataFrame, columns: list[str], values: list) -> DataFrame:
    """One row per column, one count per value; absent values are NULL."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("_v")) for c in columns]))
    )
    return long.groupBy("target").pivot("_v", values).agg(F.count(F.lit(1)))


def transitions(labelled: DataFrame) -> DataFrame:
    """Share of patients per first-to-last category change, in percent."""
    ends = labelled.groupBy("patient_id", "target").agg(
        F.min_by("cat", "visit_month").alias("_a"), F.max_by("cat", "visit_month").alias("_b")
    )
    n = F.count(F.lit(1))
    pct = lambda a, b: F.round(
        100 * F.count_if((F.col("_a") == a) & (F.col("_b") == b)) / n, 6
    )
    return ends.groupBy("target").agg(
        pct(0, 1).alias("pct_0_1"), pct(0, 0).alias("pct_0_0"), pct(1, 1).alias("pct_1_1")
    )


def reached_maximum(labelled: DataFrame, months: int = FIRST_YEAR) -> DataFrame:
    """Per (patient, target) seen in the window: did it reach its overall maximum?

    One aggregate gives the overall and the in-window maximum, so no join.
    """
    early = F.col("visit_month") <= months
    per = labelled.groupBy("patient_id", "target").agg(
        F.max("cat").alias("max_cat"), F.max(F.when(early, F.col("cat"))).alias("early_cat")
    )
    return per.withColumn("reached", F.col("early_cat") == F.col("max_cat"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, r) for every ordered pair, pairwise complete."""
    aggs = []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    for i, (a, b) in enumerate(pairs):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        terms = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        aggs += [F.sum(F.when(ok, e)).alias(f"_{i}_{k}") for k, e in terms.items()]
    row = df.agg(*aggs)
    triples = []
    for i, (a, b) in enumerate(pairs):
        r = pearson(*[f"_{i}_{k}" for k in ("n", "x", "y", "xx", "yy", "xy")])
        for u, v in {(a, b), (b, a)}:
            triples.append(
                F.struct(F.lit(u).alias("column_a"), F.lit(v).alias("column_b"), r.alias("r"))
            )
    return row.select(F.inline(F.array(*triples)))


def tertile_edges(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    return quantiles(df, group, value, {"edge_1": 1 / 3, "edge_2": 2 / 3})


def tertile_class(df: DataFrame, value: str, group: list[str], out: str = "level") -> DataFrame:
    """low / medium / high by right-closed tertile edges; ties share a class."""
    df = materialize(df, "to-class")
    edges = tertile_edges(df, value, group)
    x = F.col(value)
    return (
        df.join(F.broadcast(edges), group)
        .withColumn(
            out,
            F.when(x <= F.col("edge_1"), "low").when(x <= F.col("edge_2"), "medium").when(
                x.isNotNull(), "high"
            ),
        )
        .drop("edge_1", "edge_2")
    )
