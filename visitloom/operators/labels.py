"""Severity labels, label codes and medication checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR, MEDICATION_STATES
from visitloom.functions.scalar import binary_severity, binary_severity_of, medication_dummies


def check_medication(df: DataFrame, med: str) -> DataFrame:
    """Dummies and a per-row ``valid`` flag; NULL is a valid (unknown) state."""
    dummies = medication_dummies(med)
    return df.select(
        "*",
        *[c.alias(n) for n, c in dummies.items()],
        F.coalesce(F.col(med).isin(*MEDICATION_STATES), F.lit(True)).alias("valid"),
    )


def require_medication(df: DataFrame, med: str) -> DataFrame:
    """As ``check_medication``, but the first invalid row fails the query."""
    checked = check_medication(df, med)
    bad = F.raise_error(F.concat(F.lit("invalid medication state: "), F.col(med)))
    return checked.withColumn("med_on", F.when(F.col("valid"), F.col("med_on")).otherwise(bad)).drop(
        "valid"
    )


def encode_labels(df: DataFrame, label: str, classes: list[str], out: str) -> DataFrame:
    """Codes 0..k-1 in name order of the classes that occur in ``df``.

    ``classes`` is the closed list of class names, so the codes come from one
    aggregate row of presence flags.
    """
    present = df.agg(*[F.bool_or(F.col(label) == c).alias(f"_{i}") for i, c in enumerate(sorted(classes))])
    below = F.lit(0)
    pairs = []
    for i, c in enumerate(sorted(classes)):
        pairs.append(F.struct(F.lit(c).alias(label), below.alias(out), F.col(f"_{i}").alias("_seen")))
        below = below + F.coalesce(F.col(f"_{i}").cast("int"), F.lit(0))
    codes = present.select(F.inline(F.array(*pairs))).where("_seen").drop("_seen")
    return df.join(F.broadcast(codes), label, "left")


def visit_labels(scores: DataFrame) -> DataFrame:
    """(visit, target) rows with the 0/1 severity of the visit."""
    return scores.withColumn("cat", binary_severity_of("score"))


def per_patient(*more: str) -> Window:
    """Window over one patient's visits.

    A visits frame has one row per patient and month, so a partition holds at
    most as many rows as there are months, whatever the size of the data.
    """
    return Window.partitionBy("patient_id", *more)


def future_label(labelled: DataFrame, months: int = FIRST_YEAR) -> DataFrame:
    """Worst category over all visits of the patient, on the first visits only.

    The month filter stays behind the window: later visits must count.
    """
    worst = labelled.withColumn("max_cat", F.max("cat").over(per_patient("target")))
    return worst.where(F.col("visit_month") <= months)


def window_label(labelled: DataFrame, months: int = FIRST_YEAR) -> DataFrame:
    """Worst category within the first months only."""
    early = labelled.where(F.col("visit_month") <= months)
    return early.withColumn("max_cat", F.max("cat").over(per_patient("target")))


def patient_labels(
    visits: DataFrame, targets, months: int = FIRST_YEAR, whole_history: bool = True
) -> DataFrame:
    """(visit_id, patient_id, visit_month, target, cat, max_cat) of the first visits.

    As ``future_label`` (``whole_history``) or ``window_label``, but from the
    visits as they are: one window per patient labels all targets, and only the
    kept visits are turned into rows per target.
    """
    early = F.col("visit_month") <= months
    rows = visits if whole_history else visits.where(early)
    w = per_patient()
    wide = rows.select(
        "visit_id",
        "patient_id",
        "visit_month",
        *[binary_severity(t, t).alias(f"_c_{t}") for t in targets],
    ).select("*", *[F.max(f"_c_{t}").over(w).alias(f"_m_{t}") for t in targets])
    per_target = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(f"_c_{t}").alias("cat"), F.col(f"_m_{t}").alias("max_cat"))
            for t in targets
        ]
    )
    return wide.where(early).select("visit_id", "patient_id", "visit_month", F.inline(per_target))


def attach_month_zero(visits: DataFrame, columns: list[str]) -> DataFrame:
    """Each visit with its patient's month-0 values as ``{c}_0_month``."""
    w = per_patient()
    return visits.select(
        "*",
        *[
            F.max(F.when(F.col("visit_month") == 0, F.col(c))).over(w).alias(f"{c}_0_month")
            for c in columns
        ],
    )
