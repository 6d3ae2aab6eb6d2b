"""What is made and sent for fits: packed points, vectors of the visits asked for, rows a task can hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F

from visitloom.operators import balance, contributions, forests, model, neighbors, scoring, vectors
from visitloom.plans import models as plans
from visitloom.sources import records


def test_points_are_sent_as_bytes(spark, monkeypatch):
    rng, seen, search = np.random.default_rng(3), [], neighbors._search
    x = np.where(rng.uniform(size=(90, 40)) < 0.1, rng.normal(size=(90, 40)), 0.0)
    x[:, 0] = rng.normal(size=90)

    def watched(queries, data, *rest):
        seen.extend(dict(d.dtypes)["vec"] for d in (queries, data))
        return search(queries, data, *rest)

    monkeypatch.setattr(neighbors, "_search", watched)
    df = spark.createDataFrame(pd.DataFrame({"grp": 0, "id": np.arange(90), "vec": list(x)}), "grp int, id bigint, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for most in (100, 30):  # one block, and a tree of cells
        got = neighbors.nearest_neighbors(df, 4, n_pivots=4, block_points=most).toPandas().sort_values(["id", "place"])
        assert np.allclose(got.dist.to_numpy().reshape(90, 4), np.sort(d, 1)[:, :4], atol=1e-6)
    assert set(seen) == {"binary"}
    packed = neighbors._packed(pd.Series(list(x)))
    assert np.array_equal(neighbors.unpacked(packed), x) and max(map(len, packed)) < 8 * 40
    dense = rng.normal(size=(3, 5))
    assert np.array_equal(neighbors.unpacked(neighbors._packed(pd.Series(list(dense)))), dense)


def test_the_first_year_needs_no_vectors_of_later_visits(spark, sf, monkeypatch):
    whole = plans.visit_vectors(spark, sf).where("visit_month <= 12").select("visit_id", "features").toPandas()
    monkeypatch.setattr(plans, "_WRITTEN", {})
    rows = plans.first_year(spark, sf, "updrs_1")
    assert "vectors" not in {name for _, _, name in plans._WRITTEN}
    early = plans.early_vectors(spark, sf).select("visit_id", "features").toPandas()
    assert dict(zip(early.visit_id, early.features)) == dict(zip(whole.visit_id, whole.features))
    assert 0 < rows.count() <= len(early)


def test_a_task_of_a_fit_has_as_many_rows_as_it_can_hold(spark, monkeypatch):
    table = spark.range(1000).select(F.col("id").alias("visit_id"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    assert model.for_fits(table, 10) == (table, model.FIT_BYTES // 80_000)
    monkeypatch.setattr(model, "TASK_BYTES", 2_000)
    monkeypatch.setattr(model, "FIT_BYTES", 100_000)
    dealt, at_once = model.for_fits(table, 10)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert at_once == 1 and dealt.rdd.getNumPartitions() == 40 and sum(sizes) == 1000 and max(sizes) < 100


def test_contributions_of_absent_features(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.uniform(size=(12, 20)) < 0.4, rng.integers(1, 9, size=(12, 20)), 0)
    x[:, 0] = 1
    w = rng.permutation(20) - 10.0
    rows = [(f"v{i}", f"f{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    features = spark.createDataFrame(rows, "visit_id string, feature string, value double")
    weights = spark.createDataFrame([(f"f{j:02d}", float(w[j])) for j in range(20)], "feature string, weight double")
    got = contributions.linear_contributions(features, weights, top=5).toPandas()
    for i in range(12):
        c = [(-round(w[j] * (x[i, j] - x[:, j].mean()), 6), f"f{j:02d}") for j in range(20) if x[:, j].any()]
        mine = got[got.visit_id == f"v{i}"].sort_values("place")
        assert list(mine.feature) == [f for _, f in sorted(c)[:5]]


def test_vectors_are_as_an_assembler_makes_them(spark, sf):
    vec = plans.visit_vectors(spark, sf).select("features", vector_to_array("features").alias("x")).limit(200).collect()
    for r in vec:
        assert np.array_equal(r.features.toArray(), np.array(r.x))
        n = np.count_nonzero(r.x)
        assert (type(r.features).__name__ == "SparseVector") == (1.5 * (n + 1) < len(r.x))


def test_a_null_value_is_refused(spark):
    visits = spark.createDataFrame([("v0",)], "visit_id string")
    feats = spark.createDataFrame([("v0", "a", None)], "visit_id string, feature string, value double")
    names = spark.createDataFrame([(0, "a")], "pos int, feature string")
    with pytest.raises(Exception, match="NULL value"):
        vectors.feature_vectors(visits, feats, names, []).collect()


def _wide_points(n=400, width=300):
    """Points with some large columns and many small ones, a few of them copies."""
    rng = np.random.default_rng(12)
    x = np.where(rng.uniform(size=(n, width)) < 0.03, rng.integers(1, 9, size=(n, width)), 0).astype(float)
    x[:, :5] = rng.uniform(1_000, 2_000, size=(n, 5))
    x[-20:] = x[0]
    return x


@pytest.mark.parametrize("most", [500, 60])  # one block, and a tree of cells
def test_one_search_serves_all_folds(spark, monkeypatch, most):
    x, made = _wide_points(), []
    # the module's helpers travel to the tasks, and so does this bound
    monkeypatch.setattr(neighbors, "SOME_POINTS", 64)
    assert isinstance(neighbors._block(neighbors.packed_rows(x)), neighbors._Wide)
    fold = np.arange(len(x)) % 4
    df = spark.createDataFrame(
        pd.DataFrame({"grp": 0, "id": np.arange(len(x)), "vec": list(x), "tag": fold}), "grp int, id bigint, vec array<double>, tag int"
    )
    search = neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda *a: made.append(1) or search(*a))
    got = neighbors.nearest_neighbors(df, 4, 4, most, [0, 1, 2, 3]).toPandas().sort_values(["held", "id", "place"])
    assert len(made) <= 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for f in range(4):
        some, mine = np.flatnonzero(fold != f), got[got.held == f]
        assert mine.id.tolist() == np.repeat(some, 4).tolist() and not (mine.neighbor.to_numpy() % 4 == f).any()
        assert np.allclose(mine.dist.to_numpy().reshape(-1, 4), np.sort(d[np.ix_(some, some)], 1)[:, :4], atol=1e-6)


def test_balanced_vectors_stay_sparse(spark):
    """The same rows as from arrays, and those of the folds as those of a run of its own."""
    x = _wide_points(120)
    pdf = pd.DataFrame({"id": [f"v{i}" for i in range(120)], "label": np.r_[[1.0] * 35, [0.0] * 85], "kfold": np.arange(120) % 3, "vec": list(x)})
    arrays = spark.createDataFrame(pdf, "id string, label double, kfold int, vec array<double>")
    sparse = vectors_of(spark, arrays)
    want = balance.smote(arrays).toPandas().set_index("id").sort_index()
    out = balance.smote(sparse)
    got = out.toPandas().set_index("id").sort_index()
    assert got.index.tolist() == want.index.tolist() and got.neighbor_id.tolist() == want.neighbor_id.tolist()
    assert np.allclose(np.stack([v.toArray() for v in got.vec]), np.stack(want.vec))
    assert all(isinstance(v, SparseVector) for v in got.vec)
    for f, part in zip((0, 2), balance.smote_folds(sparse, "kfold", [0, 2])):
        own = balance.smote(sparse.where(F.col("kfold") != f)).toPandas().sort_values("id")
        part = part.toPandas().sort_values("id")
        assert part.id.tolist() == own.id.tolist() and part.neighbor_id.tolist() == own.neighbor_id.tolist()
        assert np.allclose(np.stack([v.toArray() for v in part.vec]), np.stack([v.toArray() for v in own.vec]))


def vectors_of(spark, arrays):
    rows = [(*r[:-1], Vectors.sparse(len(r[-1]), [(i, v) for i, v in enumerate(r[-1]) if v])) for r in arrays.collect()]
    return spark.createDataFrame(rows, arrays.drop("vec").schema.add("vec", VectorUDT()))


def test_records_are_read_by_the_names_they_have(spark):
    """Names that come twice in the contract or the record, no numbers, other kinds, and no month."""
    contract = spark.createDataFrame(
        [(0, "a", "protein"), (1, "b", "peptide"), (2, "c", "protein"), (2, "c", "peptide"), (3, "d", None)], "pos int, feature string, kind string"
    )

    def read(*lines):
        df = spark.createDataFrame([(x,) for x in lines], "value string").select(records.decode("value").alias("fields"))
        return scoring.record_vectors(records.visit_fields(df), contract)

    out = read(
        '{"visit_id":"v1","visit_month":0,"med":"On","a":"1.005","c":"2.5","d":"-7","x":"9"}',
        '{"patient_id":"2","visit_month":"4","a":null,"b":"1e3","b":"5","c":"zz"}',
    )
    # looked up by the names of the record, not by a pass over the contract for each
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    rows = {r["visit_id"]: r["features"] for r in out.collect()}
    assert np.allclose(rows["v1"].toArray(), [0, -1.0, 3.5, 2.5, 1, 0, 1.005, 0, 2.5, 2.5, -7])
    assert np.allclose(rows["2_4"].toArray(), [4, 1000, 0, 1000, 0, 1, 0, 1000, 0, 0, 0])
    assert read("{}").select("num_prot").first()[0] == 0
    with pytest.raises(Exception, match="NULL value in a feature vector"):
        read('{"visit_id":"v1","a":"1"}').select("features").collect()


def test_zeros_are_not_ranked(spark, monkeypatch):
    """Positions that are mostly zero get their bound without a rank for each row; the bins are those of all values."""
    rng, n = np.random.default_rng(13), 4_000
    x = np.zeros((n, 6))
    x[:, 0] = rng.normal(size=n)
    x[rng.uniform(size=n) < 0.02, 1] = 3.0
    x[rng.uniform(size=n) < 0.02, 2] = -3.0
    x[:, 3] = np.where(rng.uniform(size=n) < 0.5, rng.integers(-4, 9, n), 0)
    x[rng.uniform(size=n) < 0.0625, 4] = 2.0
    rows = [(i, i % 5, float(i % 2), Vectors.sparse(6, [(j, v) for j, v in enumerate(r) if v]) if i % 3 else Vectors.dense(r)) for i, r in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, ["id", "kfold", "label", "features"])
    ranked, slicer = [], forests.VectorSlicer
    monkeypatch.setattr(forests, "VectorSlicer", lambda **kw: ranked.extend(kw["indices"]) or slicer(**kw))
    out = forests.binned(table.repartition(4), "id").join(table.select(F.xxhash64("id").alias("row"), "id"), "row").orderBy("id").toPandas()
    assert set(ranked) == {0, 3, 4}
    got = np.stack([np.frombuffer(b, np.uint8) for b in out.bins])
    for i in range(6):
        cuts = np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16, method="inverted_cdf"))
        assert np.array_equal(got[:, i], np.searchsorted(cuts, x[:, i], "left")), i
