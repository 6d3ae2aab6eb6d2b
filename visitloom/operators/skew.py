"""Joins and per-key lookups that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.config import HOT_ROWS


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    n_rows: str = "_n",
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``per_key`` (few rows per key), splitting hot keys.

    ``per_key`` carries in ``n_rows`` how many rows its key has in ``rows``. A
    key above ``hot_rows`` is dealt over ceil(n / hot_rows) sub-keys by a hash
    of the whole row, and its ``per_key`` rows are repeated once per sub-key.
    The broadcast list holds only hot keys, so it has at most
    total_rows / hot_rows entries whatever the number of keys.
    """
    per_key = per_key.withColumn(
        "_splits", F.ceil(F.col(n_rows) / F.lit(hot_rows)).cast("int")
    ).drop(n_rows)
    hot = per_key.where("_splits > 1").select(*keys, F.col("_splits").alias("_deal")).distinct()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(
            F.col("_deal") > 1, F.pmod(F.xxhash64(*rows.columns), F.col("_deal")).cast("int")
        ).otherwise(0),
    ).drop("_deal")
    repeated = per_key.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_splits"), F.lit(1)) - 1))
    ).drop("_splits")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def attach_aggregate(
    rows: DataFrame,
    keys: list[str],
    *aggregates: Column,
    source: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Group aggregates put back on the rows of each group.

    Unlike a window over ``keys`` the aggregate combines map-side and no task
    sorts a whole group. ``source`` is the frame that is aggregated, for when
    ``rows`` is already a filtered part of it.
    """
    per_key = (source or rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return attach(rows, per_key, keys, hot_rows=hot_rows)
