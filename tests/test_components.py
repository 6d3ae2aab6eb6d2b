"""Components of sparse rows, tiled matrices and staged boosting, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from visitloom.operators import components, model, screen


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, (60, 7)).astype(float)
    x[:, 3] = x[:, 1] * 2 + (x[:, 0] > 2)
    x[:, 5] = 4.0  # constant, but never absent
    return pd.DataFrame(x, columns=[f"f{i}" for i in range(7)], index=[f"v{i:02d}" for i in range(60)])


@pytest.fixture(scope="module")
def sparse(spark, dense):
    long = dense.reset_index(names="visit_id").melt("visit_id", var_name="feature", value_name="value")
    return spark.createDataFrame(long[long.value != 0]).repartition(5)


@pytest.mark.parametrize("tile", [1, 3, 128])
def test_gram_in_tiles(dense, sparse, tile):
    names, sums = screen.gram(sparse, "value", tile)
    assert names == list(dense.columns)
    x = np.c_[dense.to_numpy(), np.ones(len(dense))]
    want = x.T @ x
    got = {(r.a, r.b): r.g for r in sums.toPandas().itertuples()}
    assert got == {(i, j): want[i, j] for i in range(8) for j in range(i, 8)}


def test_rows_sent_are_bounded(spark, sparse):
    """Blocks, not cells: a task sends (columns / tile)^2 / 2 rows at most."""
    _, sums = screen.gram(sparse, "value", 4)
    assert sums.count() == 36  # the half matrix, once


def test_components_are_those_of_numpy(dense, sparse):
    x = dense.to_numpy()
    std = x.std(0)
    z = np.where(std > 0, (x - x.mean(0)) / np.where(std > 0, std, 1), 0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    order = np.argsort(values)[::-1]
    ratio = np.cumsum(values[order]) / values.sum()
    k = int(np.argmax(ratio >= 0.95)) + 1
    vectors = vectors[:, order[:k]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    got = components.components(sparse).toPandas().pivot(index="visit_id", columns="component", values="value")
    assert list(got.columns) == list(range(1, k + 1))
    assert np.allclose(got.loc[dense.index].to_numpy(), z @ vectors, atol=1e-8)


def test_no_components(spark):
    schema = "visit_id string, feature string, value double"
    assert components.components(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(f"v{i}", "f", 2.0) for i in range(5)], schema)
    assert components.components(same).count() == 0


def test_boosting_keeps_the_best_prefix(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(v), float(t)) for v, t in zip(x, y)], ["features", "label"])
    train, held = df.limit(130), df.exceptAll(df.limit(130))

    def make(n):
        return model.classifier("gbt", maxIter=n, maxDepth=3)

    fitted, curve = model.staged_boosting(train, held, make, rounds=12, patience=50)
    assert len(curve) == 12 and fitted.getNumTrees == int(np.argmin(curve)) + 1
    assert np.allclose(fitted.evaluateEachIteration(held), curve[: fitted.getNumTrees])
    _, short = model.staged_boosting(train, held, make, rounds=12, patience=1)
    stop = next((i for i in range(1, 12) if curve[i] >= min(curve[:i])), 11)
    assert short == curve[: stop + 1]
