"""The distributed building blocks against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitloom.operators import balance, neighbors, ranking, screen, skew


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1e-3, 300), rng.lognormal(3, 4, 300), np.zeros(200), np.full(200, 5.0)])
    pdf = pd.DataFrame({"g": np.where(np.arange(1000) % 3 == 0, "a", "b"), "x": values})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(numbers):
    pdf, df = numbers
    probs = {"q0": 0.0, "q33": 0.33, "q50": 0.5, "q66": 0.66, "q100": 1.0}
    got = {r["g"]: r for r in ranking.quantiles(df, ["g"], "x", probs).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.x, p), rel=1e-12, abs=1e-15)


def test_average_ranks_match_pandas(numbers):
    pdf, df = numbers
    cells = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    got = {(r["g"], r["x"]): r["avg_rank"] for r in ranking.average_rank_cells(cells, ["g"], "x", "c").collect()}
    want = pdf.assign(r=pdf.groupby("g").x.rank())
    assert all(got[(r.g, r.x)] == r.r for r in want.itertuples())


def test_running_sum_is_a_row_number(numbers):
    _, df = numbers
    keyed = df.withColumn("id", F.monotonically_increasing_id()).withColumn("one", F.lit(1))
    got = ranking.running(keyed, [], ["x", "id"], {"one": "pos"}, ranking.magnitude_bucket("x"))
    pdf = got.toPandas().sort_values(["x", "id"])
    assert list(pdf.pos) == list(range(1000))


def test_split_hot_keys_give_the_plain_join(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    got = skew.attach_aggregate(rows, ["k"], F.max("v").alias("top"), hot_rows=30)
    want = rows.join(rows.groupBy("k").agg(F.max("v").alias("top")), "k")
    assert sorted(map(tuple, got.select("k", "v", "top").collect())) == sorted(map(tuple, want.select("k", "v", "top").collect()))


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(3)
    dense = pd.DataFrame(rng.integers(0, 6, (80, 4)).astype(float), columns=list("wxyz"), index=[f"v{i}" for i in range(80)])
    dense["y"] = dense["x"] * 2 + (dense["w"] > 4)
    dense.loc[:, "neg"] = -dense["x"]
    long = dense.reset_index(names="visit_id").melt("visit_id", var_name="feature", value_name="value")
    # zeros are left out, but each visit keeps at least one row
    sparse = long[(long.value != 0) | (long.feature == "w")]
    got = screen.spearman_matrix(spark.createDataFrame(sparse)).toPandas()
    want = dense.corr("spearman")
    assert len(got) == 10
    for r in got.itertuples():
        assert r.r == pytest.approx(want.loc[r.feature_a, r.feature_b], abs=1e-9)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(150, 6)), rng.normal(5, 0.1, size=(60, 6)), np.tile(rng.normal(size=6), (90, 1))])
    pdf = pd.DataFrame({"grp": np.arange(300) % 2, "id": np.arange(300), "vec": list(x)})
    return pdf, spark.createDataFrame(pdf, "grp int, id bigint, vec array<double>")


def test_neighbours_match_brute_force(points):
    pdf, df = points
    got = neighbors.nearest_neighbors(df, 5, n_pivots=6, block_points=20).toPandas()
    for _, part in pdf.groupby("grp"):
        x = np.stack(part.vec)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        want = dict(zip(part.id, np.sort(d, 1)[:, :5]))
        mine = got[got.id.isin(part.id)].sort_values(["id", "place"])
        assert len(mine) == 5 * len(part)
        for i, near in mine.groupby("id"):
            assert np.allclose(near.dist, want[i], atol=1e-6) and i not in set(near.neighbor)


def test_cells_are_bounded_and_pairs_grow_below_the_square(spark, monkeypatch):
    pairs, made, search, partition = [], [], neighbors._search, neighbors.partition

    def counted(queries, data, k, block_points):
        key = ["grp", "cell", "block"]
        a, b = (x.groupBy(*key).count().withColumnRenamed("count", n) for x, n in ((queries, "q"), (data, "d")))
        pairs.append(a.join(b, key).selectExpr("sum(q * d)").first()[0])
        return search(queries, data, k, block_points)

    monkeypatch.setattr(neighbors, "_search", counted)
    monkeypatch.setattr(neighbors, "partition", lambda *a: made.append(partition(*a)) or made[-1])
    rng, total = np.random.default_rng(8), []
    for n in (500, 2000):
        pdf = pd.DataFrame({"grp": 0, "id": np.arange(n), "vec": list(rng.uniform(size=(n, 2)))})
        pairs.clear()
        assert neighbors.nearest_neighbors(spark.createDataFrame(pdf, "grp int, id bigint, vec array<double>"), 3, 8, 50).count() == 3 * n
        total.append(sum(pairs))
        placed, cells = made[-1]
        assert placed.count() == n and placed.groupBy("cell").count().where("count > 50").isEmpty()
        assert cells.where("is_leaf").agg({"n": "sum"}).first()[0] == n
    # leaves hold 10 to 50 points, so the pairs of a point vary somewhat; the square would be sixteen times
    assert total[1] < 9 * total[0] and total[1] < 0.1 * 2000**2


def test_many_cells_are_joined(points, monkeypatch):
    """The same distances where no list of cells is small enough to be sent to all tasks."""
    _, df = points
    monkeypatch.setattr(neighbors, "MAX_CELLS", 0)
    test_neighbours_match_brute_force(points)


def test_smote_balances_inside_segments(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": np.arange(120), "label": [1] * 25 + [0] * 95, "kfold": np.arange(120) % 5, "vec": list(rng.normal(size=(120, 3)))})
    out = balance.smote(spark.createDataFrame(pdf, "id bigint, label int, kfold int, vec array<double>"), n_pivots=3, block_points=8).toPandas()
    assert out.groupby("label").size().tolist() == [95, 95]
    assert out.id.is_unique
    base = {str(r.id): r for r in pdf.itertuples()}
    minority = {k: np.asarray(r.vec) for k, r in base.items() if r.label == 1}
    for r in out[out.is_synthetic].itertuples():
        a, b, p = minority[r.seed_id], minority[r.neighbor_id], np.asarray(r.vec)
        gap = np.dot(p - a, b - a) / np.dot(b - a, b - a)
        assert 0 <= gap < 1 and np.allclose(p, a + gap * (b - a))
        assert r.kfold == base[r.seed_id].kfold
        dist = sorted(np.linalg.norm(v - a) for k, v in minority.items() if k != r.seed_id)
        assert np.linalg.norm(b - a) <= dist[4] + 1e-9
    per_seed = out[out.is_synthetic].groupby("seed_id").size()
    assert per_seed.max() - per_seed.min() <= 1
