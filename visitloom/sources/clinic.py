"""Clinic-shaped frames derived from the order tables.

An order is a sample, a customer a patient, months since the first order the
visit month, part brand the protein, part type + brand the peptide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitloom.functions.scalar import cents, feature_key, from_cents
from visitloom.sources.files import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with patient and calendar month number."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("patient_id"),
        "o_orderstatus",
        "o_totalprice",
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("_ym"),
    )


def _visit_id():
    return F.concat(F.col("patient_id").cast("string"), F.lit("_"), F.col("visit_month").cast("string"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit: ids, month, four nullable scores, medication state.

    Orders fold into (patient, calendar month) before the first month is
    looked up, so the window over a patient holds at most the calendar's months
    even where one patient owns a third of the orders.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.min("l_quantity").alias("_q"),
            F.min("l_extendedprice").alias("_p"),
            F.max("l_tax").alias("_tx"),
        )
    )
    joined = _orders(spark, sf_dir).join(lines, "o_orderkey", "left")
    per_month = joined.groupBy("patient_id", "_ym").agg(
        F.max("o_totalprice").alias("_price"),
        F.min("_q").alias("_q"),
        F.min("_p").alias("_p"),
        F.max(
            F.when(F.col("o_orderstatus") != "F", F.round(F.col("_tx") * 100))
        ).alias("_tx"),
        F.max(
            F.when(F.col("o_orderstatus") == "F", "On").when(
                F.col("o_orderstatus") == "O", "Off"
            )
        ).alias("med"),
    )
    first = F.min("_ym").over(Window.partitionBy("patient_id"))
    dated = per_month.withColumn("visit_month", (F.col("_ym") - first).cast("int"))
    level = F.col("patient_id") % 5 + 1
    scale = lambda x: F.floor(x * level / 5).cast("int")
    return dated.select(
        _visit_id().alias("visit_id"),
        "patient_id",
        "visit_month",
        scale(F.col("_price") / 15000).alias("updrs_1"),
        scale(F.col("_q")).alias("updrs_2"),
        scale(F.col("_p") / 1500).alias("updrs_3"),
        F.col("_tx").cast("int").alias("updrs_4"),
        "med",
    )


def _first_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("patient_id").agg(F.min("_ym").alias("_first"))


def _sample_lines(spark: SparkSession, sf_dir: str, last_month: int | None = None) -> DataFrame:
    """Line items with their patient, month, brand and type; amounts in hundredths.

    With ``last_month`` only those of visits up to it: the orders are the smallest
    table that says so, and the other lines are dropped by the first join.
    """
    orders = _orders(spark, sf_dir).select("o_orderkey", "patient_id", "_ym")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        cents("l_extendedprice").alias("price"),
        cents("l_quantity").alias("quantity"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    if last_month is None:
        return lines.join(parts, "p_partkey").join(orders, "o_orderkey")
    early = orders.join(_first_months(spark, sf_dir), "patient_id").where(F.col("_ym") - F.col("_first") <= last_month)
    return lines.join(early.drop("_first"), "o_orderkey").join(parts, "p_partkey")


def _with_visit(sums: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month since the patient's first order, and the visit id.

    ``sums`` is aggregated by patient, calendar month and feature, so a patient
    has at most months x features rows here and the join cannot be skewed.
    """
    dated = sums.join(_first_months(spark, sf_dir), "patient_id").withColumn(
        "visit_month", (F.col("_ym") - F.col("_first")).cast("int")
    )
    return dated.withColumn("visit_id", _visit_id()).drop("_ym", "_first")


def proteins(spark: SparkSession, sf_dir: str, last_month: int | None = None) -> DataFrame:
    """Long protein table, one row per (visit, protein), of all visits or those up to a month."""
    sums = (
        _sample_lines(spark, sf_dir, last_month)
        .groupBy("patient_id", "_ym", F.col("p_brand").alias("UniProt"))
        .agg(from_cents(F.sum("price")).alias("NPX"))
    )
    return _with_visit(sums, spark, sf_dir).select(
        "visit_id", "visit_month", "patient_id", "UniProt", "NPX"
    )


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long peptide table, one row per (visit, protein, peptide)."""
    sums = (
        _sample_lines(spark, sf_dir)
        .groupBy(
            "patient_id", "_ym", F.col("p_brand").alias("UniProt"), F.col("p_type").alias("Peptide")
        )
        .agg(from_cents(F.sum("quantity")).alias("PeptideAbundance"))
    )
    return _with_visit(sums, spark, sf_dir).select(
        "visit_id", "UniProt", "Peptide", "PeptideAbundance"
    )


def protein_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein part of the long feature frame."""
    return proteins(spark, sf_dir).select(
        "visit_id",
        F.lit("protein").alias("kind"),
        F.col("UniProt").alias("feature"),
        F.col("NPX").alias("value"),
    )


def features(spark: SparkSession, sf_dir: str, last_month: int | None = None) -> DataFrame:
    """Long feature frame (visit_id, kind, feature, value) of both kinds, of all visits or those up to a month.

    Each line item gives its protein and its peptide row and one aggregate sums
    both, so the lines are read, joined and shuffled once. Both kinds come from
    the same lines, so no visit has peptides only; ``operators.shape.long_features``
    has the semi-join for tables of other origin.
    """
    both = F.array(
        F.struct(
            F.lit("protein").alias("kind"),
            F.col("p_brand").alias("feature"),
            F.col("price").alias("amount"),
        ),
        F.struct(
            F.lit("peptide").alias("kind"),
            feature_key("p_type", "p_brand").alias("feature"),
            F.col("quantity").alias("amount"),
        ),
    )
    sums = (
        _sample_lines(spark, sf_dir, last_month)
        .select("patient_id", "_ym", F.inline(both))
        .groupBy("patient_id", "_ym", "kind", "feature")
        .agg(from_cents(F.sum("amount")).alias("value"))
    )
    return _with_visit(sums, spark, sf_dir).select("visit_id", "kind", "feature", "value")
