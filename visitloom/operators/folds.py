"""Bins, stratified folds and hash splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.config import N_FOLDS
from visitloom.functions.scalar import shuffle_bucket, shuffle_key
from visitloom.operators.ranking import running
from visitloom.session import materialize


def sturges(n_rows) -> Column:
    """Bin count floor(1 + log2(n))."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return F.floor(1 + F.log2(n.cast("double"))).cast("int")


def bin_of(x, low, high, n_bins) -> Column:
    """Right-closed equal-width bin 0..n-1; the minimum is in bin 0.

    A constant column has one bin.
    """
    share = F.try_divide((x - low).cast("double"), (high - low).cast("double"))
    return F.greatest(
        F.lit(0), F.ceil(F.coalesce(share, F.lit(0.0)) * n_bins).cast("int") - 1
    )


def equal_width_bins(
    df: DataFrame, value: str, group: list[str], n_bins, out: str = "bin"
) -> DataFrame:
    """Bin of each row over its group's range. Groups are score targets.

    ``n_bins`` is a number, or a column that is constant per group.
    """
    edges = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    n = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    return (
        df.join(F.broadcast(edges), group)
        .withColumn(out, bin_of(F.col(value), F.col("_lo"), F.col("_hi"), n))
        .drop("_lo", "_hi")
    )


def stratified_folds(
    df: DataFrame,
    stratum: str,
    key: str = "visit_id",
    group: tuple[str, ...] = ("target",),
    n_folds: int = N_FOLDS,
    seed: int = 42,
    out: str = "kfold",
    stored: bool = False,
    n_rows: str | None = None,
) -> DataFrame:
    """Fold ids with the per-(class, fold) counts of a stratified k-fold.

    Rows are laid out by (class, shuffle key) inside their group and dealt
    round robin, so class sizes differ by at most one between folds. Positions
    come from bucket totals (class, key prefix), so neither a group nor a class
    is sorted as a whole. ``stratum`` is a small non-negative integer and
    ``n_rows`` a column with the rows of the group, which sizes the buckets.
    """
    keyed = df.withColumn("_k", shuffle_key(seed, key)).withColumn("_one", F.lit(1))
    bucket = F.col(stratum) * F.lit(16**5) + shuffle_bucket("_k", n_rows)
    placed = running(keyed, list(group), [stratum, "_k"], {"_one": "_pos"}, bucket, stored=stored)
    return placed.withColumn(out, F.pmod("_pos", F.lit(n_folds)).cast("int")).drop(
        "_k", "_one", "_pos", *([n_rows] if n_rows else [])
    )


def binned_folds(
    df: DataFrame,
    value: str = "score",
    n_rows: str | int | None = None,
    key: str = "visit_id",
    seed: int = 42,
    stored: bool = False,
) -> DataFrame:
    """Folds stratified by the binned score of each target.

    The bin count follows Sturges' rule on ``n_rows``: a number, the name of a
    column that holds it, or (default) the rows of each target. The rows are
    read for their range, their bucket totals and their positions, so they are
    written once first; ``stored`` says they come from a written table already.
    """
    if not stored:
        df = materialize(df, "to-fold")
    # one row per target
    stats = df.groupBy("target").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    size = F.col("_n") if n_rows is None else F.col(n_rows) if isinstance(n_rows, str) else F.lit(n_rows)
    binned = df.join(F.broadcast(stats), "target").withColumn(
        "_bin", bin_of(F.col(value), F.col("_lo"), F.col("_hi"), sturges(size))
    )
    drop = ["_lo", "_hi", *([n_rows] if isinstance(n_rows, str) else [])]
    folded = stratified_folds(binned.drop(*drop), "_bin", key, seed=seed, stored=True, n_rows="_n")
    return folded.drop("_bin")


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train`` by the key's hash: independent of partitioning and reruns."""
    bits = F.conv(F.substring(shuffle_key(seed, key), 1, 7), 16, 10).cast("bigint")
    return df.withColumn("is_train", (bits / F.lit(268435456.0)) < F.lit(share))
