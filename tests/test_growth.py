"""What keeps the work in proportion to the input: rows, groups and histograms that are made once."""

import json

import numpy as np
import pandas as pd
from pyspark.ml.linalg import SparseVector

from visitloom.operators import components, forests, screen, shape, vectors
from visitloom.operators.forests import Grown, Tree
from visitloom.sources import clinic
from visitloom.streaming import baseline


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_are_made_where_the_values_are(spark):
    """A visit's components are neither shuffled nor listed one by one."""
    rows = [(f"v{i}", f, float((i * 7 + j * 3 + i * j) % 5 + 1)) for i in range(20) for j, f in enumerate("abcd") if (i + j) % 4]
    feats = spark.createDataFrame(rows, "visit_id string, feature string, value double")
    names, lists = screen.listed(feats, "value")
    from visitloom.session import materialize

    lists = materialize(lists, "lists")
    loadings, constant, _ = components.fit(lists, len(names))
    made = components.project(lists, loadings, constant)
    assert "Exchange" not in _plan(made)
    got = {r.visit_id: r.components for r in made.collect()}
    dense = pd.DataFrame(rows).pivot(index=0, columns=1, values=2).fillna(0.0)
    assert all(np.allclose(got[v], dense.loc[v].to_numpy() @ loadings - constant) for v in dense.index)


def test_vectors_of_few_values_are_sparse(spark):
    names = spark.createDataFrame([(i, f"f{i:03d}") for i in range(100)], "pos int, feature string")
    feats = spark.createDataFrame([("a", "f005", 2.0), ("a", "f090", 3.0)], "visit_id string, feature string, value double")
    visits = spark.createDataFrame([("a", 4), ("b", 0)], "visit_id string, visit_month int")
    got = {r.visit_id: r.features for r in vectors.feature_vectors(visits, feats, names, ["visit_month"]).collect()}
    assert got["a"] == SparseVector(101, {0: 4.0, 6: 2.0, 91: 3.0}) and isinstance(got["a"], SparseVector)
    assert got["b"].size == 101 and not got["b"].toArray().any()


def test_trees_that_are_alike_share_histograms(spark):
    """Depths and least rows of one draw are one tree until their splits differ."""
    trees = [Tree((0, 1, 2), 0, 1, max_depth=d, min_rows=m) for d in range(1, 14) for m in (1, 2)]
    trees += [Tree((0, 1, 2), 0, 2, max_depth=3)]
    empty = Grown(trees, np.full((27, 3), -1, np.int32), np.zeros((27, 3), np.int32), np.zeros((27, 3)))
    assert [len(c.trees) for c in forests._level(empty, 0, 4)] == [26, 1]


def test_deep_levels_send_cells_with_rows_only(spark):
    rng = np.random.default_rng(2)
    bins = np.zeros((300, 40), np.uint8)
    bins[np.arange(300), rng.integers(0, 40, 300)] = 3
    rows = [(int(i), int(i % 3), float(i % 2), bytearray(b.tobytes())) for i, b in enumerate(bins)]
    table = spark.createDataFrame(rows, "row long, fold int, label double, bins binary").coalesce(1)
    one = Grown([Tree(tuple(range(40)), 0)], np.full((1, 15), -1, np.int32), np.zeros((1, 15), np.int32), np.zeros((1, 15)))
    chunks, usual = forests._level(one, 0, 16), forests._usual_bins(table, 16)
    sent = table.mapInArrow(forests._histograms(one, chunks, 0, 16, usual), "chunk int, cells binary, sums binary").collect()
    # of 640 cells those with rows, one a feature, and the node's total
    assert not usual.any() and len(sent) == 1 and 20 < len(sent[0].cells) // 4 <= 41


class _State:
    """Stands for a bucket's state."""

    def __init__(self):
        self.kept, self.now, self.hasTimedOut, self.limit = None, 1000, False, None

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)

    def update(self, kept):
        self.kept = kept

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.limit = self.now + ms


def test_patients_of_a_bucket_are_served_in_one_call():
    """A call for each patient cost milliseconds; limits of patients that sent nothing still count."""
    state, t = _State(), ("updrs_1",)

    def send(*rows):
        frame = pd.DataFrame(rows, columns=["visit_id", "patient_id", "visit_month", "scores"])
        got = [tuple(None if pd.isna(x) else x for x in r) for out in baseline._advance((0,), iter([frame]), state, t, 500) for r in out.itertuples(index=False)]
        return sorted((p, m, c) for _, p, m, _, c in got)

    assert send(("1_0", 1, 0, [5]), ("1_2", 1, 2, [8]), ("2_3", 2, 3, [4]), ("1_2", 1, 2, [9])) == [(1, 0, 0), (1, 2, 3)]
    assert state.limit == 1500
    state.now = 1400
    assert send(("3_0", 3, 0, [1]), ("1_4", 1, 4, [None])) == [(1, 4, None), (3, 0, 0)]
    state.now = 1600
    assert send(("3_1", 3, 1, [7])) == [(2, 3, None), (3, 1, 6)]
    state.now = 1700
    assert send(("2_3", 2, 3, [4]), ("2_0", 2, 0, [1]), ("2_5", 2, 5, [2])) == [(2, 0, 0), (2, 5, 1)]
    assert set(json.loads(state.kept[0])) == {"1", "2", "3"}


def test_pivot_meets_once(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "z", 3.0), ("b", None, 2.0)], "v string, f string, value double")
    wide = shape.pivot_unique(df, ["v"], "f", "value", ["x", "y"])
    assert _plan(wide).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, None), ("b", None, None)]


def test_early_lines_are_those_of_early_visits(spark, tmp_path):
    """Lines of later visits are dropped before they are joined; the rows are the same."""
    orders = [(k, k % 7, "F", 10.0 * k, f"{1995 + k % 4}-{k % 12 + 1:02d}-03") for k in range(60)] + [(90, None, "O", 1.0, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "cast(d as timestamp) AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k % 5, 3.0 + k, 100.0 * k) for k in range(60)] * 2 + [(90, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (3, None, 1.0, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"b{i % 3}", f"t{i}") for i in range(5)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    month = "cast(split(visit_id, '_')[1] AS int) <= 12"
    for early, whole in (
        (clinic.features(spark, str(tmp_path), 12), clinic.features(spark, str(tmp_path))),
        (clinic.proteins(spark, str(tmp_path), 12), clinic.proteins(spark, str(tmp_path))),
    ):
        want = sorted(map(tuple, whole.where(month).collect()))
        assert want and len(want) < whole.count() and sorted(map(tuple, early.collect())) == want
