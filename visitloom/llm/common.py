"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import visitloom

# A word is a run without space, tab, line feed, vertical tab, form feed or
# carriage return; in Python ``bytes.split()`` cuts at just these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, *without: str) -> Column:
    """The columns of ``docs`` in one struct, so that no helper column can clash.

    Columns named in ``without`` are left out because the caller carries them.
    """
    skip = {c.lower() for c in without}
    kept = [c for c in docs.columns if c.lower() not in skip]
    return F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))


def unpacked(
    frame: DataFrame, columns: list[str], made: dict[str, Column], row: str = "row"
) -> DataFrame:
    """The columns of the struct again, then ``made``, which wins where names clash."""
    taken = {c.lower() for c in made}
    return frame.select(
        *[F.col(row)[c].alias(c) for c in columns if c.lower() not in taken],
        *[value.alias(name) for name, value in made.items()],
    )


def row_digest(docs: DataFrame) -> Column:
    """Digest of a whole row. With the id it names a row; rows equal in both are one row repeated."""
    return F.xxhash64(packed(docs))


def _whole(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(packed(docs).alias("row"), F.col(id_col).alias("id"), row_digest(docs).alias("tie"))


def _same_row(frame: DataFrame, keys: DataFrame):
    return frame["id"].eqNullSafe(keys["id"]) & (frame["tie"] == keys["tie"])


def rows_without(docs: DataFrame, id_col: str, keys: DataFrame) -> DataFrame:
    """``row`` of each row whose (``id``, ``tie``) isn't in ``keys``."""
    whole = _whole(docs, id_col)
    return whole.join(keys, _same_row(whole, keys), "left_anti").select("row")


def rows_of(docs: DataFrame, id_col: str, keys: DataFrame, value: str) -> DataFrame:
    """``row`` and the ``value`` of its key, for each row whose (``id``, ``tie``) is in ``keys``."""
    whole = _whole(docs, id_col)
    return whole.join(keys, _same_row(whole, keys)).select("row", value)


def one_row_of(docs: DataFrame, id_col: str, keys: DataFrame, value: str) -> DataFrame:
    """As ``rows_of``, but once for each key, for keys of repeated rows."""
    whole = _whole(docs, id_col)
    found = whole.join(keys, _same_row(whole, keys)).select(whole["id"], whole["tie"], "row", value)
    return found.groupBy("id", "tie").agg(F.first("row").alias("row"), F.first(value).alias(value)).select("row", value)


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application.

    Spark's file server hands the driver's archive to the executors, which need
    neither an installation nor a shared folder for it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(visitloom.__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="visitloom-")), "visitloom-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _SHIPPED[context.applicationId] = archive
