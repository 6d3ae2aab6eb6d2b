"""Long and wide shaping of feature frames.

The long form (visit_id, kind, feature, value) is the working form: a missing
row is a zero, so width costs nothing until a wide result is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalar import cents, feature_key, from_cents


def long_features(
    proteins: DataFrame, peptides: DataFrame, peptide_first: bool = True
) -> DataFrame:
    """Both tables as feature rows; visits that have peptides only are dropped."""
    prot = proteins.select(
        "visit_id",
        F.lit("protein").alias("kind"),
        F.col("UniProt").alias("feature"),
        F.col("NPX").alias("value"),
    )
    pept = peptides.select(
        "visit_id",
        F.lit("peptide").alias("kind"),
        feature_key("Peptide", "UniProt", peptide_first).alias("feature"),
        F.col("PeptideAbundance").alias("value"),
    ).where("feature is not null")
    sampled = prot.select("visit_id").distinct()
    return prot.unionByName(pept.join(sampled, "visit_id", "left_semi"))


def pivot_unique(
    df: DataFrame, index: list[str], column: str, value: str, names: list[str]
) -> DataFrame:
    """Wide frame with one column per name in ``names``.

    The name list is given, so no pass over the data collects it. Two rows for
    one cell are an error, as in a strict pivot. The cells of a row meet once, as a
    list, so what a task holds is cells that are there and not rows times names.
    """
    cell = F.struct(F.col(column).alias("name"), F.col(value).alias("value"))
    lists = df.groupBy(*index).agg(F.collect_list(cell).alias("_cells"))
    found = F.col("_cells")["name"]
    twice = F.raise_error(F.concat(F.lit(f"duplicate {column} for {index}: "), F.array_max(found)))
    checked = F.when(F.size(F.array_distinct(found)) < F.size(found), twice).otherwise(F.col("_cells"))

    def value_of(name: str):
        own = F.filter("_cells", lambda c: c["name"] == F.lit(name))
        return F.get(own, F.lit(0))["value"].alias(name)

    return lists.withColumn("_cells", checked).select(*index, *[value_of(n) for n in names])


def first_of_name(
    df: DataFrame, key: list[str], value: str, position: list[str]
) -> DataFrame:
    """One row per key: the value that comes first by position."""
    return df.groupBy(*key).agg(
        F.min_by(value, F.struct(*position, value)).alias(value)
    )


def conform(visits: DataFrame, contract: DataFrame, features: DataFrame) -> DataFrame:
    """Long rows of every contract feature for every visit, in contract order.

    Missing features become 0 and features outside the contract are dropped,
    before anything is shuffled. ``visits`` holds (visit_id, target), ``contract``
    (target, pos, feature); a visit's rows are packed once, so only present values
    of contract features are shuffled. The contract is one list per target, as wide
    as the measured features.
    """
    lists = contract.groupBy("target").agg(F.collect_list("feature").alias("_names"))
    wanted = F.broadcast(contract.select("feature").distinct())
    packed = features.join(wanted, "feature", "left_semi").groupBy("visit_id").agg(
        F.collect_list(F.struct("feature", "value")).alias("_have")
    )
    joined = visits.join(packed, "visit_id", "left").join(F.broadcast(lists), "target")
    have = F.coalesce("_have", F.array().cast("array<struct<feature:string,value:double>>"))
    absent = F.array_except("_names", have["feature"])
    rows = F.concat(
        have,
        F.transform(absent, lambda f: F.struct(f.alias("feature"), F.lit(0.0).alias("value"))),
    )
    return joined.select("visit_id", "target", F.inline(rows)).join(
        F.broadcast(contract), ["target", "feature"]
    )


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def transpose(df: DataFrame, key: str, columns: list[str], keys: list[str], name: str) -> DataFrame:
    """Rows become columns: one row per column, one column per key value."""
    long = df.unpivot([key], columns, name, "_v")
    return long.groupBy(name).pivot(key, keys).agg(F.first("_v", ignorenulls=True))


def visit_totals(features: DataFrame, kind: str = "kind") -> DataFrame:
    """Sums per visit over proteins, peptides and both, plus real counts.

    Sums run in whole hundredths, so they do not depend on the order of rows.
    """
    amount = cents("value")
    is_prot = F.col(kind) == "protein"
    none = F.lit(0).cast("bigint")
    return features.groupBy("visit_id").agg(
        from_cents(F.sum(amount)).alias("num_prot_pep"),
        from_cents(F.sum(F.when(is_prot, amount).otherwise(none))).alias("num_prot"),
        from_cents(F.sum(F.when(~is_prot, amount).otherwise(none))).alias("num_pept"),
        F.count_if(is_prot & (F.col("value") > 0)).alias("n_prot_gt_0"),
        F.count_if(~is_prot & (F.col("value") > 0)).alias("n_pept_gt_0"),
    )


def pair_products(features: DataFrame, visit: str = "visit_id") -> DataFrame:
    """Products of every two features of a visit, named ``a_b`` with a before b.

    Only pairs with both values present are non-zero, so only those are made.
    A visit holds each feature at most once, so its list is no longer than the
    contract; the pairs are built inside the row, with one shuffle in all.
    """
    lists = features.groupBy(visit).agg(
        F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("_f")
    )
    pairs = F.flatten(
        F.transform(
            "_f",
            lambda a, i: F.transform(
                F.slice("_f", i + 2, F.greatest(F.size("_f") - i - 1, F.lit(0))),
                lambda b: F.struct(
                    F.concat(a["feature"], F.lit("_"), b["feature"]).alias("feature"),
                    (a["value"] * b["value"]).alias("value"),
                ),
            ),
        )
    )
    return lists.select(visit, F.inline(pairs))
