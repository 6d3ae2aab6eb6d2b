"""Exact positions in an ordered group without sorting the group in one task.

Every operator here first folds rows into *cells* (one per distinct order
value, with a count), then numbers the cells in two levels: bucket totals are
cumulated over at most a fixed number of buckets, and cells are cumulated
inside their bucket. The bucket is any expression that is monotone in the order
value; it decides balance only, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.config import RANK_BUCKETS
from visitloom.session import materialize


def magnitude_bucket(x, per_octave: int = 64) -> Column:
    """Monotone bucket of a number of any scale: sign, then log2 steps.

    Balanced for values spread over any range; at most about 2 * 2100 *
    ``per_octave`` buckets exist for doubles.
    """
    x = F.col(x) if isinstance(x, str) else x
    step = F.floor(F.log2(F.abs(x).cast("double")) * per_octave).cast("int") + F.lit(1_000_000)
    return F.when(x == 0, F.lit(0)).when(x > 0, step).otherwise(-step)


def even_bucket(x, low, high, n: int = RANK_BUCKETS) -> Column:
    """Monotone equal-width bucket of ``x`` in [low, high]."""
    return F.floor(
        F.coalesce(F.try_divide((x - low).cast("double"), (high - low).cast("double")), F.lit(0.0))
        * (n - 1)
    ).cast("int")


def running(
    cells: DataFrame,
    group: list[str],
    order: list,
    weights: dict[str, str],
    bucket: Column,
    totals: dict[str, str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Sum of each weight over the cells strictly before a cell, in its group.

    ``weights`` maps a weight column to the name of its running sum, ``totals``
    a weight column to the name of its sum over the group. The cells are read
    twice, so they are written once first; ``stored`` says they come from a
    written table already.
    """
    totals = totals or {}
    cells = cells.withColumn("_bucket", bucket)
    if not stored:
        cells = materialize(cells, "cells")
    sums = cells.groupBy(*group, "_bucket").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
            for w in weights
        ],
        *[F.sum(f"_t_{w}").over(whole).alias(name) for w, name in totals.items()],
    )
    in_bucket = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cells.select(
        "*",
        *[
            F.coalesce(F.sum(w).over(in_bucket), F.lit(0)).alias(f"_i_{w}")
            for w in weights
        ],
    )
    return inside.join(offsets, [*group, "_bucket"]).select(
        *[c for c in cells.columns if c != "_bucket"],
        *[(F.col(f"_o_{w}") + F.col(f"_i_{w}")).alias(name) for w, name in weights.items()],
        *totals.values(),
    )


def quantiles(
    values: DataFrame,
    group: list[str],
    value: str,
    probabilities: dict[str, float],
    bucket: Column | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per probability.

    NULL values are ignored. No buffer ever holds a group's values: equal
    values fold into cells, and a cell only says which wanted positions it
    covers.
    """
    cells = (
        values.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    numbered = running(
        cells,
        group,
        ["_v"],
        {"_c": "_before"},
        bucket if bucket is not None else magnitude_bucket("_v"),
        totals={"_c": "_n"},
    )
    picks = []
    for i, p in enumerate(probabilities.values()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for j, at in enumerate((F.floor(pos), F.ceil(pos))):
            inside = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_q{i}_{j}"))
    picked = numbered.groupBy(*group).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, (name, p) in enumerate(probabilities.items()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*group, *out)


def average_rank_cells(
    cells: DataFrame, group: list[str], value: str, count: str, bucket: Column | None = None
) -> DataFrame:
    """Average rank (ties share it) of every distinct value in its group."""
    ranked = running(
        cells, group, [value], {count: "_before"}, bucket if bucket is not None else magnitude_bucket(value)
    )
    return ranked.withColumn(
        "avg_rank", F.col("_before") + (F.col(count) + 1) / F.lit(2.0)
    ).drop("_before")
