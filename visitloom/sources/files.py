"""Typed scans and sinks. Schemas are explicit, so no read infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VISITS = T.StructType(
    [
        T.StructField("visit_id", T.StringType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("visit_month", T.IntegerType()),
        T.StructField("updrs_1", T.IntegerType()),
        T.StructField("updrs_2", T.IntegerType()),
        T.StructField("updrs_3", T.IntegerType()),
        T.StructField("updrs_4", T.IntegerType()),
        T.StructField("med", T.StringType()),
    ]
)
PROTEINS = T.StructType(
    [
        T.StructField("visit_id", T.StringType()),
        T.StructField("visit_month", T.IntegerType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("UniProt", T.StringType()),
        T.StructField("NPX", T.DoubleType()),
    ]
)
PEPTIDES = T.StructType(
    [
        T.StructField("visit_id", T.StringType()),
        T.StructField("UniProt", T.StringType()),
        T.StructField("Peptide", T.StringType()),
        T.StructField("PeptideAbundance", T.DoubleType()),
    ]
)
REQUESTS = T.StructType(
    [
        T.StructField("visit_id", T.StringType()),
        T.StructField("visit_month", T.IntegerType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("updrs_test", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("group_key", T.LongType()),
    ]
)


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """What changes when the tables of a folder are rewritten: times, total length, number of files.

    Asked of the file system in a call a table and one for the folder, without reading data.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(sf_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    times = sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.globStatus(path(f"{sf_dir}/*.parquet")))
    whole = fs.getContentSummary(path(sf_dir))
    return (*times, whole.getLength(), whole.getFileCount())


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; an empty field is NULL, a malformed row fails."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, VISITS)


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PROTEINS)


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PEPTIDES)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REQUESTS)


def write_by_target(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per target, so a reader of one target prunes the rest."""
    writer = df.write.partitionBy("target")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_predictions_json(df: DataFrame, path: str) -> None:
    """One JSON object per visit and line."""
    df.write.json(path)


def prediction_records(df: DataFrame, key: str = "visit_id") -> DataFrame:
    """The record of each visit as JSON text."""
    return df.select(key, F.to_json(F.struct("*")).alias("record"))


def name_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    """Give positional columns their contract names, if the count agrees."""
    if len(df.columns) != len(names):
        raise ValueError(
            f"input has {len(df.columns)} columns {df.columns} but the contract has "
            f"{len(names)}: {names}"
        )
    return df.toDF(*names)
