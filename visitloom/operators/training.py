"""Training and request sets for all targets, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.config import TARGETS
from visitloom.functions.scalar import severity_of
from visitloom.operators.folds import binned_folds
from visitloom.operators.shape import visit_totals
from visitloom.session import materialize


def sampled_visits(visits: DataFrame, features: DataFrame) -> DataFrame:
    """Visits with a sample, and their feature totals."""
    return visits.join(visit_totals(features), "visit_id")


def training_index(
    visits: DataFrame, features: DataFrame, targets=TARGETS, seed: int = 42
) -> DataFrame:
    """One row per (sampled visit, target with a score): fold, category, totals.

    Bins follow Sturges' rule on the sampled visits before NULL scores drop.
    The feature values stay in the long frame, keyed by visit. The visits with
    their totals are written once, as counts, bins and folds all read them.
    """
    return index_of(materialize(sampled_visits(visits, features), "sampled-visits"), targets, seed)


def index_of(base: DataFrame, targets=TARGETS, seed: int = 42) -> DataFrame:
    """``training_index`` of sampled visits with their totals, from a written table."""
    n_rows = F.broadcast(base.agg(F.count(F.lit(1)).alias("_rows")).withColumn("_j", F.lit(1)))
    ids = ["visit_id", "patient_id", "visit_month", "num_prot_pep", "num_prot", "num_pept"]
    long = base.unpivot(ids, list(targets), "target", "score").where("score is not null")
    sized = long.withColumn("_j", F.lit(1)).join(n_rows, "_j").drop("_j")
    folded = binned_folds(sized, "score", "_rows", seed=seed, stored=True)
    return folded.withColumn("cat", severity_of("score"))


def request_index(visits: DataFrame, features: DataFrame, targets=TARGETS) -> DataFrame:
    """As the training index but unfolded: one row per (sampled visit, target).

    The medication column is optional and dropped.
    """
    base = sampled_visits(visits.drop("med"), features)
    ids = ["visit_id", "patient_id", "visit_month", "num_prot_pep", "num_prot", "num_pept"]
    return base.select(
        *ids, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    )
