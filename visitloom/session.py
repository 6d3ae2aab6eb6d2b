"""Session for local runs, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("visitloom")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # test tables are small: keep the cores busy instead of merging partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # a test table is one file and so one scan task: shuffle mid-sized joins,
        # as a cluster would, rather than finish them inside that task
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests) gets one fresh folder of
    its own; any other session is an error, as its executors share no folder
    that is known here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        made = tempfile.mkdtemp(prefix="visitloom-")
        context.setCheckpointDir(made)
        _LOCAL_DIRS[context.applicationId] = made
    return _LOCAL_DIRS[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds several jobs (model fits): the lineage is cut and
    the table survives the loss of executors, unlike a cache.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
