"""Feature contracts and hyper-parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_contract(lists: DataFrame) -> DataFrame:
    """(target, pos, feature) from rows of (target, JSON array text)."""
    return lists.select(
        "target",
        F.posexplode(F.from_json("features", "array<string>")).alias("pos", "feature"),
    )


def read_contract(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Contract file: a JSON array of names, or one name per line."""
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    as_json = F.from_json(F.trim("raw"), "array<string>")
    as_lines = F.filter(F.split("raw", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    names = F.when(F.trim("raw").startswith("["), as_json).otherwise(
        F.transform(as_lines, lambda x: F.trim(x))
    )
    return text.select(F.lit(target).alias("target"), F.posexplode(names).alias("pos", "feature"))


def contract_of(features: DataFrame, targets) -> DataFrame:
    """(target, pos, feature): the distinct features in name order, per target."""
    names = features.select("feature").distinct()
    # one row: the contract itself, whose width is the number of measured features
    ordered = names.agg(F.sort_array(F.collect_list("feature")).alias("_names"))
    return ordered.select(
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"), "_names"
    ).select("target", F.posexplode("_names").alias("pos", "feature"))


def unpivot_params(wide: DataFrame, targets) -> DataFrame:
    """(param, target, value) of a table with one row per parameter."""
    return wide.unpivot(["param"], list(targets), "target", "value")


def decode_params(
    long: DataFrame, names: dict[str, list[str]], whole: tuple[str, ...]
) -> DataFrame:
    """Readable parameter values.

    ``names`` lists, per parameter, the choice behind each index; ``whole``
    are parameters whose float value stands for an integer.
    """
    table = F.create_map(
        *[
            x
            for param, choices in names.items()
            for i, choice in enumerate(choices)
            for x in (F.lit(f"{param}:{i}"), F.lit(choice))
        ]
    )
    index = F.col("value").cast("int").cast("string")
    named = F.try_element_at(table, F.concat_ws(":", "param", index))
    text = F.when(F.col("param").isin(list(names)), named).when(
        F.col("param").isin(list(whole)), index
    ).otherwise(F.round("value", 6).cast("string"))
    return long.select("param", "target", F.round("value", 6).alias("value"), text.alias("decoded"))
