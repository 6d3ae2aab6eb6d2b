"""Feature screening in long form: correlations, transforms, pruning.

Zeros are implicit, so every moment takes its row count from the sampled
visits and not from the feature rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scalar import pearson, yeo_johnson
from visitloom.operators import rank_blocks
from visitloom.session import materialize

# Tasks carry this module's helpers with them, so workers need not import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns on a side of the blocks in which a matrix is added up.
TILE = 128
# Numbers of the dense rows that a task holds at once.
DENSE_CELLS = 2_000_000


def packed(features: DataFrame) -> DataFrame:
    """One row per sampled visit with its (feature, value) list.

    A visit holds each feature once, so a list is no longer than the contract.
    """
    return features.groupBy("visit_id").agg(
        F.collect_list(F.struct("feature", "value")).alias("kv")
    )


def n_sampled(features: DataFrame) -> DataFrame:
    """One row: the number of visits that have any feature."""
    return F.broadcast(
        features.agg(F.countDistinct("visit_id").alias("n")).withColumn("_j", F.lit(1))
    )


def target_correlations(
    features: DataFrame, visits: DataFrame, targets: list[str]
) -> DataFrame:
    """(target, feature, r): each zero-filled feature against each score.

    Feature sums come from the present rows; n, sum(y) and sum(y^2) from the
    sampled visits, zeros included. Both aggregate map-side to one row per
    feature and one row in all. ``features`` is read twice: pass a table.
    """
    scores = visits.select("visit_id", *[F.col(t).cast("double").alias(t) for t in targets])
    x = F.col("value")

    def moments(named) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("target"), *named(F.col(t))) for t in targets])

    def per_feature(y):
        known = lambda e: F.sum(F.when(y.isNotNull(), e))
        return known(x).alias("sx"), known(x * x).alias("sxx"), known(x * y).alias("sxy")

    def per_target(y):
        return F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")

    sums = (
        features.select("visit_id", "feature", "value")
        .join(scores, "visit_id")
        .groupBy("feature")
        .agg(moments(per_feature).alias("_m"))
        .select("feature", F.inline("_m"))
    )
    sampled = scores.join(features.select("visit_id"), "visit_id", "left_semi")
    bases = sampled.agg(moments(per_target).alias("_m")).select(F.inline("_m"))
    return sums.join(F.broadcast(bases), "target").select(
        "target", "feature", pearson("n", "sx", "sy", "sxx", "syy", "sxy").alias("r")
    )


def feature_moments(features: DataFrame) -> DataFrame:
    """(feature, n, mean, std): population moments over all sampled visits."""
    x = F.col("value")
    sums = features.groupBy("feature").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    full = sums.withColumn("_j", F.lit(1)).join(n_sampled(features), "_j")
    mean = F.col("sx") / F.col("n")
    var = F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0))
    return full.select("feature", "n", mean.alias("mean"), F.sqrt(var).alias("std"))


def standardize(features: DataFrame, moments: DataFrame) -> DataFrame:
    """Standardized values of the present rows.

    A missing row stands for a zero, whose standardized value is the constant
    -mean/std of its feature (``zero_value``); a constant feature gives NULL.
    """
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    zero = F.try_divide(-F.col("mean"), F.col("std"))
    return features.join(F.broadcast(moments), "feature").select(
        "visit_id", "feature", z.alias("z"), zero.alias("zero_value")
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block for each tile, the sum of its blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for tile, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            part = np.frombuffer(block)
            total[tile] = total[tile] + part if tile in total else part
    for tile, block in total.items():
        columns = [pa.array([tile], pa.int32()), pa.array([0], pa.int32()), pa.array([block.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["tile", "part", "block"])


def _lists(cells: DataFrame) -> DataFrame:
    """(visit_id, pos, val) lists of the (visit_id, pos, val) rows of each visit; a row of no column adds none.

    The rows of a visit come from as many tasks as it has columns, so they meet first
    and are not folded before.
    """
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", "val"))
    lists = cells.repartition("visit_id").groupBy("visit_id").agg(F.collect_list(cell).alias("_kv"))
    return lists.select("visit_id", F.col("_kv")["pos"].alias("pos"), F.col("_kv")["val"].alias("val"))


def listed(rows: DataFrame, value: str) -> tuple[list[str], DataFrame]:
    """The names of the columns, and (visit_id, pos, val): a visit's columns as positions and values.

    A NULL value is a 0, as an absent row is. The names are listed on the driver.
    """
    names = [r[0] for r in rows.select("feature").distinct().orderBy("feature").collect()]
    index = rows.sparkSession.createDataFrame(list(enumerate(names)), "pos int, feature string")
    cell = F.struct("pos", F.coalesce(F.col(value), F.lit(0.0)).alias("val"))
    lists = rows.join(F.broadcast(index), "feature").groupBy("visit_id").agg(F.collect_list(cell).alias("_kv"))
    return names, lists.select("visit_id", F.col("_kv")["pos"].alias("pos"), F.col("_kv")["val"].alias("val"))


def gram(rows: DataFrame, value: str, tile: int = TILE) -> tuple[list[str], DataFrame]:
    """The names of the columns, and (a, b, g), a <= b, of columns that are 0 where absent.

    g is the sum over visits of the products of two columns; the last column is the
    constant 1, for the sums and the count. Each task folds its visits into one matrix
    and hands it on in blocks of ``tile`` columns, which are added up in two steps: a
    task sends (columns / tile)^2 / 2 rows, and a block meets the square root of the
    tasks at a time. The matrix is as wide as the contract, whose names are listed on
    the driver.
    """
    names, lists = listed(rows, value)
    return names, gram_of_lists(lists, len(names), tile)


def gram_of_lists(lists: DataFrame, n_columns: int, tile: int = TILE) -> DataFrame:
    """``gram`` of visits that have their (pos, val) lists already."""

    def dense(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
        pos, val = batch.columns
        x = np.zeros((len(pos), width))
        x[:, n_columns] = 1.0
        at = np.repeat(np.arange(len(pos)), np.diff(np.asarray(pos.offsets)))
        x[at, np.asarray(pos.flatten())] = np.asarray(val.flatten())
        yield x

    return _gram(lists.select("pos", "val"), dense, n_columns, tile)


def gram_of_blocks(blocks: DataFrame, n_columns: int, tile: int = TILE) -> DataFrame:
    """``gram`` of the visits that ``rank_blocks.ranks`` gives a value."""
    step = max(1, DENSE_CELLS // (n_columns + 1))

    def dense(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
        for cells in zip(*(c.to_pylist() for c in batch.columns)):
            row, pos, u = (np.frombuffer(c, kind) for c, kind in zip(cells, (np.int32, np.int32, np.float64)))
            for start in range(0, int(row.max()) + 1, step):
                here = (row >= start) & (row < start + step)
                at = row[here] - start
                if len(at):
                    x = np.zeros((at.max() + 1, width))
                    x[at, n_columns] = 1.0
                    x[at, pos[here]] = u[here]
                    yield x

    return _gram(blocks.select("row", "pos", "u"), dense, n_columns, tile)


def _gram(
    rows: DataFrame, dense: Callable[[pa.RecordBatch, int], Iterator[np.ndarray]], n_columns: int, tile: int
) -> DataFrame:
    """``gram`` of the rows that ``dense`` makes of a batch, filled up to a number of columns."""
    spark = rows.sparkSession
    width = n_columns + 1
    n_tiles = -(-width // tile)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = max(1, round(parts**0.5))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_tiles * tile, n_tiles * tile))
        for batch in batches:
            for x in dense(batch, n_tiles * tile):
                total += x.T @ x
        if total[width - 1, width - 1]:
            blocks = total.reshape(n_tiles, tile, n_tiles, tile).swapaxes(1, 2)
            i, j = np.triu_indices(n_tiles)
            part = TaskContext.get().partitionId() % split
            columns = [
                pa.array((i * n_tiles + j).astype(np.int32)),
                pa.array(np.full(len(i), part, np.int32)),
                pa.array([blocks[c].tobytes() for c in zip(i, j)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "part", "block"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                i, j = divmod(of, n_tiles)
                a, b = (x.ravel() + k * tile for x, k in zip(np.indices((tile, tile)), (i, j)))
                use = np.flatnonzero((a <= b) & (b < width))
                columns = [pa.array(a[use].astype(np.int32)), pa.array(b[use].astype(np.int32)), pa.array(np.frombuffer(block)[use])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "g"])

    schema = "tile int, part int, block binary"
    sums = (
        rows.mapInArrow(products, schema)
        .repartition(parts, "tile", "part").mapInArrow(_summed, schema)
        .repartition(parts, "tile").mapInArrow(_summed, schema)
        .mapInArrow(cells, "a int, b int, g double")
    )
    return materialize(sums, "gram")


def matrix_from_sparse(rows: DataFrame, value: str) -> DataFrame:
    """(feature_a, feature_b, r), a before b, of columns that are 0 where absent."""
    return _correlations(*gram(rows, value))


def _correlations(names: list[str], sums: DataFrame) -> DataFrame:
    """(feature_a, feature_b, r) from the sums of ``gram``."""
    spark, width = sums.sparkSession, len(names)
    index = spark.createDataFrame(list(enumerate(names)), "pos int, feature string")
    # from here on everything is as long as the square of the contract
    ones = sums.where(F.col("b") == width).select("a", F.col("g").alias("s"))
    singles = sums.where((F.col("a") == F.col("b")) & (F.col("a") < width)).select(
        "a", F.col("g").alias("ss")
    ).join(ones, "a").join(F.broadcast(index.select(F.col("pos").alias("a"), "feature")), "a")
    n = ones.where(F.col("a") == width).select(F.lit(width).alias("_w"), F.col("s").alias("n"))
    left = singles.select("a", F.col("feature").alias("feature_a"), F.col("s").alias("sa"), F.col("ss").alias("saa"))
    right = singles.select(
        F.col("a").alias("b"), F.col("feature").alias("feature_b"), F.col("s").alias("sb"), F.col("ss").alias("sbb")
    )
    pairs = sums.where((F.col("a") < F.col("b")) & (F.col("b") < width)).withColumn("_w", F.lit(width))
    return (
        pairs.join(F.broadcast(left), "a")
        .join(F.broadcast(right), "b")
        .join(F.broadcast(n), "_w")
        .select("feature_a", "feature_b", pearson("n", "sa", "sb", "saa", "sbb", "g").alias("r"))
    )


def spearman_matrix(features: DataFrame) -> DataFrame:
    """Rank correlation of every two features over all sampled visits.

    ``features`` is read twice: pass a table, not a long lineage. Its rows move once, to
    their visits, which are written as lists and ranked in blocks. A NULL value has no
    rank and counts as a zero, and a visit without any known value doesn't count. Of
    several values of a visit and feature, as without a visit id, the largest counts.
    """
    x = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))
    found = x.where("feature is not null and known > 0").orderBy("feature").collect()
    names = [r["feature"] for r in found]
    index = features.sparkSession.createDataFrame(list(enumerate(names)), "pos int, feature string")
    cells = features.join(F.broadcast(index), "feature", "left")
    lists = materialize(_lists(cells.select("visit_id", "pos", F.col("value").cast("double").alias("val"))), "lists")
    n = lists.where("visit_id is not null").count()
    ranked = rank_blocks.ranks(lists, n, {i: r["n"] for i, r in enumerate(found)})
    return _correlations(names, gram_of_blocks(ranked, len(names)))


def high_pairs(matrix: DataFrame, limit: float = 0.75) -> DataFrame:
    """Pairs at or above ``limit``, and pairs below -``limit``."""
    return matrix.where((F.col("r") >= limit) | (F.col("r") < -limit))


def prune_correlated(matrix: DataFrame, limit: float = 0.75) -> list[str]:
    """Features kept after dropping one of every pair at or above ``limit``.

    The member with the larger mean correlation goes, the first on ties; means
    are updated by subtraction. The matrix is as large as the square of the
    contract, never of the data, and the choice is sequential by nature.
    """
    rows = matrix.select("feature_a", "feature_b", "r").toPandas()
    names = sorted(set(rows.feature_a) | set(rows.feature_b))
    total = {f: 1.0 for f in names}
    size = {f: 1 for f in names}
    near: dict[str, dict[str, float]] = {f: {} for f in names}
    for x, y, r in rows.itertuples(index=False):
        if r is None or r != r:
            continue
        near[x][y] = near[y][x] = float(r)
        for f in (x, y):
            total[f] += float(r)
            size[f] += 1
    kept = set(names)
    edges = sorted((x, y) for x in names for y, r in near[x].items() if x < y and r >= limit)
    for x, y in edges:
        if x not in kept or y not in kept:
            continue
        gone = y if total[y] / size[y] > total[x] / size[x] else x
        kept.discard(gone)
        for f, r in near[gone].items():
            if f in kept:
                total[f] -= r
                size[f] -= 1
    return sorted(kept)


def yeo_johnson_fit(features: DataFrame, lambdas: list[float], scale: str = "std") -> DataFrame:
    """(feature, lambda, log_likelihood) of the best lambda in the grid.

    Values are divided by their standard deviation first, so powers stay in
    range. The likelihood is a sum over values, zeros contribute a constant, so
    the whole grid is one aggregate over the present rows.
    """
    stats = feature_moments(features).where(F.col(scale) > 0)
    scaled = features.join(F.broadcast(stats), "feature").select(
        "feature", "n", (F.col("value") / F.col(scale)).alias("x")
    )
    # every grid point is one aggregate column group: rows are not multiplied
    x = F.col("x")
    aggs = []
    for lam in lambdas:
        y = yeo_johnson(x, F.lit(float(lam)))
        aggs.append(
            F.struct(F.lit(float(lam)).alias("lambda"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
        )
    sums = scaled.groupBy("feature").agg(
        F.max("n").alias("n"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("slog"),
        F.array(*aggs).alias("_g"),
    )
    return _most_likely(sums.select("feature", "n", "slog", F.inline("_g")))


def yeo_johnson_refined(
    features: DataFrame, coarse: list[float], rounds: int = 1, points: int = 10
) -> DataFrame:
    """Best lambda after refining around the coarse winner of each feature.

    The refined grid is the coarse winner plus or minus one coarse step; every
    feature has its own grid, so lambda is a column and not a literal.
    """
    best = yeo_johnson_fit(features, coarse)
    step = coarse[1] - coarse[0]
    for _ in range(rounds):
        best = _refine(features, best, step, points)
        step = 2 * step / points
    return best


def _refine(features: DataFrame, best: DataFrame, step: float, points: int) -> DataFrame:
    stats = feature_moments(features).where("std > 0").join(best.select("feature", "lambda"), "feature")
    scaled = features.join(F.broadcast(stats), "feature").select(
        "feature", "n", F.col("lambda").alias("_at"), (F.col("value") / F.col("std")).alias("x")
    )
    x = F.col("x")
    aggs = []
    for i in range(-points // 2, points // 2 + 1):
        offset = i * 2 * step / points
        y = yeo_johnson(x, F.col("_at") + offset)
        aggs.append(
            F.struct(F.lit(float(offset)).alias("offset"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
        )
    sums = scaled.groupBy("feature", "_at").agg(
        F.max("n").alias("n"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("slog"),
        F.array(*aggs).alias("_g"),
    )
    grid = sums.select("feature", "n", "slog", "_at", F.inline("_g")).withColumn(
        "lambda", F.col("_at") + F.col("offset")
    )
    return _most_likely(grid)


def _most_likely(grid: DataFrame) -> DataFrame:
    var = F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), F.lit(2))
    ll = -F.col("n") / 2 * F.log(F.when(var > 0, var)) + (F.col("lambda") - 1) * F.col("slog")
    known = grid.withColumn("log_likelihood", ll).where("log_likelihood is not null")
    return known.groupBy("feature").agg(
        F.max_by("lambda", F.struct("log_likelihood", -F.col("lambda"))).alias("lambda"),
        F.max("log_likelihood").alias("log_likelihood"),
    )


def yeo_johnson_apply(features: DataFrame, lambdas: DataFrame, scale: str = "std") -> DataFrame:
    """Transformed, standardized values; an absent row keeps its zero's value.

    A zero maps to zero under every lambda, so the moments of the transformed
    feature need its present rows and the visit count only.
    """
    stats = feature_moments(features).where(F.col(scale) > 0).select("feature", scale)
    fit = stats.join(lambdas.select("feature", "lambda"), "feature")
    moved = features.join(F.broadcast(fit), "feature").select(
        "visit_id", "feature", yeo_johnson(F.col("value") / F.col(scale), F.col("lambda")).alias("value")
    )
    return standardize(moved, feature_moments(moved))


def above_mean(importance: DataFrame, group: list[str]) -> DataFrame:
    """Features whose importance reaches the mean of their group."""
    w = Window.partitionBy(*group)
    return (
        importance.withColumn("_mean", F.avg("importance").over(w))
        .where(F.col("importance") >= F.col("_mean"))
        .drop("_mean")
    )


def derived_features(features: DataFrame) -> DataFrame:
    """Squares and reciprocals as features of their own; 1/0 gives no row."""
    x: Column = F.col("value")
    made = features.select(
        "visit_id",
        F.inline(
            F.array(
                F.struct(F.concat("feature", F.lit("^2")).alias("feature"), (x * x).alias("value")),
                F.struct(
                    F.concat("feature", F.lit("_inverse")).alias("feature"),
                    F.try_divide(F.lit(1.0), x).alias("value"),
                ),
            )
        ),
    )
    return made.where("value is not null")
