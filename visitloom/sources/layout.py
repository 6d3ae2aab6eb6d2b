"""Tables laid out for their readers: bucketed and sorted by the key they are joined on.

Joins and aggregates over the bucket key need no shuffle, for every reader of the
table, at the price of one when it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from visitloom.session import fresh_path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as table ``name`` in ``buckets`` buckets of ``key`` and return the table.

    Rows are dealt by the bucket's own hash first, so that a bucket is one file
    and not one a task. Rows with a null key share a bucket. Two tables join
    without a shuffle if their bucket counts agree, or one divides the other.
    An existing table is an error, never overwritten.
    """
    if buckets < 1:
        raise ValueError("a table needs at least one bucket")
    spark = df.sparkSession
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path or fresh_path(spark, name))
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def join_stored(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join bucket by bucket: a merge join reads both sides in place, whatever their size."""
    return left.join(right.hint("merge"), key, how)


def buckets_for(n_bytes: int, bucket_bytes: int = 256 << 20) -> int:
    """The power of two of buckets that keeps one at ``bucket_bytes`` or less, if evenly filled.

    Powers of two divide each other, so that tables of any two sizes join in place.
    """
    return 1 << max(0, (max(1, n_bytes) - 1) // bucket_bytes).bit_length()
