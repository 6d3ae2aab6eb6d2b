"""Mixing sources to target weights by systematic sampling.

Each document expects ``target / source size`` copies. Within its source the
expectations are summed in order of size, one random offset is added, and a
document is emitted once for each integer boundary that its step crosses. In
size order the emitted words stay within about one large document of the target.

The running sum is exact and has no one-task sort: rows are range-partitioned by
source and order, each range sums its own rows, and ranges start at the sum of
the ranges before. Sums are whole numbers, so partitioning doesn't change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import WORD, one_row_of, packed, row_digest, rows_of, shuffle_parts, unpacked
from visitloom.session import materialize

# One copy in the fixed-point unit of the running sums.
UNIT = 1_000_000_000


def n_words(text) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` for rows of (``source``, ``size``).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times the whole size. No target passes ``most`` times the size of
    its source; the excess goes to the others by weight. With sources ordered by
    limit / weight those at their limit come first, so one pass finds the level
    of the rest. There is one row for each source here, not for each document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    ).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every)
    return per.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest).alias("target"),
    )


def random_offset(group, seed: str) -> Column:
    """One offset in [0, UNIT) for each group, fixed by the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")
    return F.shiftright(digits * F.lit(UNIT), 28)


def systematic_copies(
    rows: DataFrame, group: str, units: str, order: list[str], seed: str = "mix"
) -> DataFrame:
    """``rows`` with ``copies``: how often the row is emitted.

    ``units`` holds the expected copies times ``UNIT``, as a long. Rows that are
    equal in ``group`` and ``order`` may swap their copies, nothing else depends
    on partitioning. A null group is a group of its own.
    """
    parts = shuffle_parts(rows.sparkSession)
    keys = [F.col(group), *[F.col(c) for c in order]]
    numbered = rows.withColumn("_units", F.col(units))
    dealt = materialize(
        numbered.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    # at most one row for each source and range it touches: parts + sources
    sums = dealt.groupBy(group, "_part").agg(F.sum(F.col("_units").cast("decimal(20,0)")).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) + random_offset(group, seed)
    starts = materialize(
        sums.select(
            F.col(group).alias("_group"),
            F.col("_part").alias("_range"),
            F.pmod(offset, F.lit(UNIT).cast("decimal(38,0)")).cast("long").alias("_start"),
        ),
        "starts",
    )
    here = Window.partitionBy(group, "_part").orderBy(*order)
    upto = F.sum("_units").over(here.rowsBetween(Window.unboundedPreceding, 0))
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range"))
    # the sum first: it shuffles by the keys of the join
    joined = dealt.withColumn("_upto", upto).join(starts, on)
    # whole-number division: no rounding at any length of the sum
    crossed = F.expr(f"(_start + _upto) div {UNIT} - (_start + _upto - _units) div {UNIT}")
    return joined.select(*rows.columns, crossed.alias("copies"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with ``size``, ``source_size``, ``target`` of its source and ``copies``.

    ``carry`` names the columns to return, all if not given; it should be narrow,
    as the rows are shuffled (``mixed`` repeats whole documents).

    Defined cases: a null size counts as 0; a null source is the last source; a
    null id sorts first; rows with one id are taken one by one; a source of size
    0 has target 0 and gives nothing; an empty table gives an empty table. No
    row is emitted more than ``ceil(most)`` times.
    """
    carry = docs.columns if carry is None else carry
    rows = materialize(
        docs.select(
            packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    # a written table has a known size: Spark broadcasts it only if it is small
    targets = materialize(source_targets(rows, weights, share, most), "targets")
    targets = targets.withColumnRenamed("source", "_source")
    rate = F.col("target") / F.col("source_size") * F.lit(float(UNIT))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "id", "source", "size", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).cast("long").alias("units"),
        F.xxhash64("row").alias("tie"),
    )
    done = systematic_copies(rows, "source", "units", ["size", "id", "tie"], seed)
    return unpacked(done, carry, {c: F.col(c) for c in ("size", "source_size", "target", "copies")})


def mixed(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (see ``mix``).

    ``docs`` is read again for the rows that are taken: pass a stored table.
    """
    id_col, source_col = options.pop("id_col", "doc_id"), options.pop("source_col", "source")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        row_digest(docs).alias("tie"),
        F.col(source_col).alias("source"),
        size.alias("size"),
    )
    copies = (
        mix(narrow, F.col("size"), "id", "source", carry=["id", "tie"], **options)
        .groupBy("id", "tie")
        .agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
        .where("copies > 0")
    )
    copies = materialize(copies, "copies")
    single = rows_of(docs, id_col, copies.where("n = 1"), "copies")
    # a row that is there more than once gives the copies of all
    repeated = one_row_of(docs, id_col, copies.where("n > 1"), "copies")
    return (
        single.union(repeated)
        .select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .select(*[F.col("row")[c].alias(c) for c in docs.columns])
    )
