"""Mergeable quantile sketches of scores, by target and month.

One pass over the visits makes a sketch for each target and month; any window of
months is then answered by merging a few hundred small rows, without reading the
visits again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators.ranking import quantiles

# Size of a sketch, and the rank error stated for it: three times what the
# sketch keeps with 99 % confidence at this size. A group of at most SIZE scores is exact.
SIZE = 400
RANK_ERROR = 0.02


def monthly(scores: DataFrame) -> DataFrame:
    """(target, visit_month, n, sketch) of the known scores; a month without one has no row."""
    return (
        scores.where("score is not null")
        .groupBy("target", "visit_month")
        .agg(
            F.count("*").alias("n"),
            F.kll_sketch_agg_bigint(F.col("score").cast("bigint"), F.lit(SIZE)).alias("sketch"),
        )
    )


def _in_windows(rows: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Each row once for every window (first and last month) that holds its month."""
    named = F.array(
        *[
            F.when(F.col("visit_month").between(first, last), F.lit(name))
            for name, (first, last) in windows.items()
        ]
    )
    return rows.withColumn("window", F.explode(F.array_compact(named)))


def windowed(
    sketches: DataFrame, windows: dict[str, tuple[int, int]], probabilities: dict[str, float]
) -> DataFrame:
    """(target, window, n, one column a probability): quantiles of merged sketches.

    A quantile is a score that occurs; the rank it has differs from the wanted
    one by at most ``RANK_ERROR`` of ``n``. A window without scores has no row.
    """
    merged = (
        _in_windows(sketches, windows)
        .groupBy("target", "window")
        .agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", SIZE).alias("_s"))
    )
    at = {q: F.kll_sketch_get_quantile_bigint("_s", F.lit(float(p))) for q, p in probabilities.items()}
    return merged.select("target", "window", "n", *[c.alias(q) for q, c in at.items()])


def compared(
    scores: DataFrame,
    sketches: DataFrame,
    windows: dict[str, tuple[int, int]],
    probabilities: dict[str, float],
) -> DataFrame:
    """Sketched beside exact quantiles: adds ``<q>_exact`` and ``<q>_error`` to ``windowed``.

    The error is how far, as a share of ``n``, the wanted rank is from the ranks
    that the sketched score has: 0 where it is one of them.
    """
    known = _in_windows(scores.where("score is not null").select("target", "visit_month", "score"), windows)
    estimated = windowed(sketches, windows, probabilities)
    key = ["target", "window"]
    exact = quantiles(known, key, "score", {f"{q}_exact": p for q, p in probabilities.items()})
    # a row for each target and window, whatever the data
    joined = known.join(F.broadcast(estimated), key)
    errors = joined.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in ("n", *probabilities)],
        *[
            F.greatest(
                F.lit(0.0),
                F.count_if(F.col("score") < F.col(q)) / F.max("n") - F.lit(float(p)),
                F.lit(float(p)) - F.count_if(F.col("score") <= F.col(q)) / F.max("n"),
            ).alias(f"{q}_error")
            for q, p in probabilities.items()
        ],
    )
    return errors.join(exact, key)
