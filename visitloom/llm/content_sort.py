"""Exact deduplication by sorting contents.

Sampled splitters deal the normalised texts over ranges, each range is sorted
externally, equal texts lie side by side and every row is compared in full with
its neighbour. The splitters are drawn from a short prefix and a digest of the
whole text, so a sample never holds whole documents; rows of one text share
both, so they always meet.

A text with more copies than a fair share of a task is dealt over several runs.
Each run is compared in full as above, then the runs of a text, of which there
are few, are compared in full among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import packed, shuffle_parts
from visitloom.session import materialize

# Code points of a text that order the ranges; ties go by the digest.
SPLITTER_CHARS = 32
# A run may hold this share of a task's fair share of rows ...
RUNS_PER_TASK = 4
# ... but splitting smaller groups than this gains nothing.
LEAST_RUN = 64


def _returned(
    final: DataFrame, carry: list[str], text: dict[str, Column], made: dict[str, Column]
) -> DataFrame:
    taken = {c.lower() for c in made}
    return final.select(
        *[text.get(c, F.col("row")[c]).alias(c) for c in carry if c.lower() not in taken],
        *[value.alias(name) for name, value in made.items()],
    )


def _grouped(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    normalise: Callable[[Column], Column] | None,
    keep: str,
    carry: list[str],
) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Rows in a struct, the decision columns, and the text where it isn't in the struct."""
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text_col), F.lit(""))
    body = plain if normalise is None else F.coalesce(normalise(plain), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != text_col.lower()]
    # without a normaliser the text itself is what is sorted: it travels once
    once = normalise is None and text_col in carry
    rows = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry]), *([text_col] if once else [])).alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(*others).alias("tie"),
        F.col(text_col).isNull().alias("was_null"),
        body.alias("body"),
        F.substring(body, 1, SPLITTER_CHARS).alias("head"),
        F.xxhash64(body).alias("digest"),
    )
    parts = shuffle_parts(spark)
    fair = max(LEAST_RUN, docs.count() // (RUNS_PER_TASK * parts))
    # at most rows / fair <= RUNS_PER_TASK * parts texts, whatever the input
    hot = (
        rows.groupBy("digest")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(fair)).cast("int").alias("n_runs"))
        .where("n_runs > 1")
    )
    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "run",
        F.when(F.col("n_runs") > 1, F.pmod(F.xxhash64("id", "tie"), F.col("n_runs"))).otherwise(0),
    )

    best = [
        F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last(),
        F.col("tie").asc(),
    ]
    same = Window.partitionBy("head", "digest", "run", "body").orderBy(*best)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        dealt.repartitionByRange(parts, "head", "digest", "run")
        .withColumn("place", F.row_number().over(same))
        .withColumn("best", F.first(F.struct("id", "tie")).over(whole))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("sha", F.sha2("body", 256))
        .withColumn("split", F.coalesce(F.col("n_runs") > 1, F.lit(False)))
        # the body goes on where it is returned, and once a run where runs must meet
        .withColumn("rep", F.when(F.col("split") & (F.col("place") == 1), F.col("body")))
    )
    runs = runs.select(
        "row", "id", "tie", "place", "best", "n", "sha", "split", "rep",
        *(["body", "was_null"] if once else []),
    )
    runs = materialize(runs, "runs")

    meet = Window.partitionBy("rep")
    first = meet.orderBy(
        F.col("best.id").desc_nulls_last() if keep == "max" else F.col("best.id").asc_nulls_last(),
        F.col("best.tie").asc(),
    )
    # one row for each split text: at most RUNS_PER_TASK * parts
    merged = (
        runs.where("split AND place = 1")
        .select(
            F.col("sha").alias("of"),
            F.first("best").over(first).alias("all_best"),
            F.sum("n").over(meet).alias("all_n"),
            F.row_number().over(first).alias("_p"),
        )
        .where("_p = 1")
        .drop("_p")
    )
    on = F.col("split") & (F.col("sha") == F.col("of"))
    final = runs.join(F.broadcast(merged), on, "left")
    chosen = F.coalesce("all_best", "best")
    made = {
        "keep_id": chosen["id"],
        "group_size": F.coalesce("all_n", "n"),
        "kept": (F.col("place") == 1)
        & F.col("id").eqNullSafe(chosen["id"])
        & F.col("tie").eqNullSafe(chosen["tie"]),
        "text_sha256": F.col("sha"),
    }
    text = {text_col: F.when(~F.col("was_null"), F.col("body"))} if once else {}
    return final, made, text


def content_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with the decision of its group of equal texts.

    Adds ``keep_id`` (id of the row that stays: the smallest, or the largest
    with ``keep="max"``), ``group_size``, ``kept`` and ``text_sha256`` (of the
    normalised text). ``carry`` names the input columns to return, all of them
    if not given; one named like an added column is replaced.

    Defined cases: a null text counts as empty. A null id is never preferred to
    another; if all ids of a group are null, ``keep_id`` is null. Just one row
    of a group is kept, also where ids repeat: the rest of the row decides, and
    rows equal in every column are interchangeable. An empty table gives an
    empty table.
    """
    carry = docs.columns if carry is None else carry
    final, made, text = _grouped(docs, id_col, text_col, normalise, keep, carry)
    return _returned(final, carry, text, made)


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
) -> DataFrame:
    """The rows that stay, one for each distinct normalised text, with the columns of ``docs``."""
    final, made, text = _grouped(docs, id_col, text_col, normalise, keep, docs.columns)
    return _returned(final.where(made["kept"]), docs.columns, text, {})
