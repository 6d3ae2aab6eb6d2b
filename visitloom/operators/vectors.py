"""From the long feature frame to ML vectors, without a wide pivot."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from visitloom.session import fresh_path


def dense(kv: Column, width: Column) -> Column:
    """Dense array of ``width`` from a position-sorted array of (pos, value).

    Built from runs of zeros between the present positions, so the work per row
    is the width and no lookup is made.
    """
    runs = F.transform(
        kv,
        lambda s, i: F.concat(
            F.array_repeat(
                F.lit(0.0),
                s["pos"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(kv, i - 1)["pos"]) - 1,
            ),
            F.array(s["value"]),
        ),
    )
    last = F.coalesce(F.get(kv, F.size(kv) - 1)["pos"], F.lit(-1))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), width - last - 1))


def feature_vectors(
    rows: DataFrame, features: DataFrame, contract: DataFrame, extra: list[str], out: str = "features"
) -> DataFrame:
    """``rows`` (with visit_id) plus a vector: the extra columns, then the contract.

    The contract is an allow-list (pos, feature): ids, labels, folds and raw
    scores cannot enter. Features outside it are dropped, missing ones are 0.
    Only present values are shuffled. The contract is as short as the number of
    measured features, so its lookup is broadcast. A vector is sparse where that is
    the smaller form, as it is stored, shuffled and cached by what fits models on it.
    It is made from the present values and written once in its stored form, so that
    only a vector that is dense goes through an array as long as the contract.
    """
    width = F.broadcast(contract.agg(F.count(F.lit(1)).cast("int").alias("_width")).withColumn("_j", F.lit(1)))
    listed = features.join(F.broadcast(contract.select("pos", "feature")), "feature")
    lists = listed.groupBy("visit_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_kv")
    )
    joined = rows.join(lists, "visit_id", "left").withColumn("_j", F.lit(1)).join(width, "_j")
    kv = F.coalesce("_kv", F.array().cast("array<struct<pos:int,value:double>>"))
    values = joined.withColumn("_kv", kv)
    n = len(extra)
    first = [F.struct(F.lit(i).alias("pos"), F.col(c).cast("double").alias("value")) for i, c in enumerate(extra)]
    moved = F.transform("_kv", lambda s: F.struct((s["pos"] + n).alias("pos"), s["value"].alias("value")))
    unknown = F.raise_error(F.lit("NULL value in a feature vector"))
    cells = F.filter(
        F.concat(F.array(*first), moved) if extra else moved,
        lambda s: F.when(s["value"].isNull(), unknown).otherwise(s["value"] != 0),
    )
    listed = values.withColumn("_cells", cells).withColumn("_size", F.col("_width") + n)
    # as Vector.compressed decides it
    sparse = 1.5 * (F.size("_cells") + 1) < F.col("_size")
    stored = F.struct(
        F.when(sparse, F.lit(0)).otherwise(F.lit(1)).cast("tinyint").alias("type"),
        F.when(sparse, F.col("_size")).alias("size"),
        F.when(sparse, F.col("_cells")["pos"]).alias("indices"),
        F.when(sparse, F.col("_cells")["value"]).otherwise(dense(F.col("_cells"), F.col("_size"))).alias("values"),
    )
    path = fresh_path(rows.sparkSession, "vectors")
    made = listed.select(*rows.columns, stored.alias(out))
    made.write.parquet(path)
    # the size is given, so that what fits models need not read a row to learn it
    sized = {"ml_attr": {"num_attrs": n + contract.count()}}
    read = StructType([*rows.schema.fields, StructField(out, VectorUDT(), True, sized)])
    return rows.sparkSession.read.schema(read).parquet(path)
