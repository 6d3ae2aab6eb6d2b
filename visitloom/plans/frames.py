"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.config import SCORED_TARGETS, TARGETS
from visitloom.functions.scalar import binary_severity_of, hash_score
from visitloom.session import materialize
from visitloom.sources import clinic


def scores(spark: SparkSession, sf_dir: str, targets=TARGETS) -> DataFrame:
    """(visit_id, patient_id, visit_month, med, target, score), NULL scores kept."""
    return clinic.visits(spark, sf_dir).unpivot(
        ["visit_id", "patient_id", "visit_month", "med"], list(targets), "target", "score"
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with a 0/1 label and a pseudo-probability per target."""
    s = scores(spark, sf_dir, SCORED_TARGETS).where("score is not null")
    return s.select(
        "visit_id",
        "patient_id",
        "visit_month",
        "target",
        binary_severity_of("score").alias("label"),
        hash_score(F.concat("target", F.lit(":"), "visit_id")).alias("p"),
    )


def stored_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein features as a written table, for operators that read them often."""
    return materialize(clinic.protein_features(spark, sf_dir), "proteins")


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of both kinds as a written table."""
    return materialize(clinic.features(spark, sf_dir), "features")
