"""Ranks of visits in blocks against pandas, and what is written for them."""

import numpy as np
import pandas as pd
import pytest

from visitloom.operators import rank_blocks, ranking, screen
from visitloom.session import materialize


@pytest.fixture(scope="module")
def long():
    rng = np.random.default_rng(12)
    x = pd.DataFrame(rng.normal(size=(300, 4)).round(2), columns=list("abcd"), index=[f"v{i:03d}" for i in range(300)])
    x["b"] = np.where(rng.random(300) < 0.7, 5.0, x["a"])  # most rows tie
    x["c"] = np.abs(x["c"]) + 1
    x = x.mask(rng.random(x.shape) < 0.3, 0.0)
    x["one"] = 1.0  # every visit has a row
    x.iloc[:20, 3] = -0.0
    rows = x.reset_index(names="visit_id").melt("visit_id", var_name="feature", value_name="value")
    return x, rows[(rows.value != 0) | (rows.feature == "d")]


@pytest.mark.parametrize("stretch_rows", [7, 100, 1_000_000])
def test_ranks_of_blocks_match_pandas(spark, long, stretch_rows):
    x, rows = long
    names, lists = screen.listed(spark.createDataFrame(rows), "value")
    lists = materialize(lists.repartition(6), "lists")  # six blocks or more
    have = rows.groupby("feature").size()
    blocks = rank_blocks.ranks(lists, len(x), {i: int(have[f]) for i, f in enumerate(names)}, stretch_rows).collect()
    assert len(blocks) >= 3
    rank = x.rank()
    zero = {f: (x[f] < 0).sum() + ((x[f] == 0).sum() + 1) / 2 for f in names}
    got = {f: [] for f in names}
    for b in blocks:
        for pos, u in zip(np.frombuffer(b["pos"], np.int32), np.frombuffer(b["u"])):
            got[names[pos]].append(u)
    for f in names:
        there = rows[rows.feature == f].visit_id
        want = [0.0 if x.loc[v, f] == 0 else rank.loc[v, f] - zero[f] for v in there]
        assert sorted(got[f]) == sorted(want)


def test_correlation_of_many_stretches(spark, long, monkeypatch):
    x, rows = long
    monkeypatch.setattr(rank_blocks.ranks, "__defaults__", (50,))
    got = screen.spearman_matrix(spark.createDataFrame(rows).repartition(5)).toPandas()
    want = x.corr("spearman")
    assert len(got) == 10
    for r in got.itertuples():
        assert (np.isnan(r.r) if "one" in (r.feature_a, r.feature_b) else r.r == pytest.approx(want.loc[r.feature_a, r.feature_b], abs=1e-9))


def test_unknown_values(spark):
    """A NULL has no rank and is no zero; a visit of NULLs only doesn't count; a NULL feature is none."""
    known = [("v0", "a", 1.0), ("v0", "b", 2.0), ("v1", "a", 3.0), ("v1", "b", 1.0), ("v2", "a", 2.0), ("v3", "b", 4.0)]
    odd = [("v2", "b", None), ("v4", "a", None), ("v4", "c", None), ("v3", None, 2.0), ("v5", None, 1.0)]
    schema = "visit_id string, feature string, value double"
    got = [tuple(r) for r in screen.spearman_matrix(spark.createDataFrame(known + odd, schema)).collect()]
    # six visits are named, so a has two zeros less its NULL, b three less its NULL; four visits count
    absent = {"a": 6 - 4, "b": 6 - 4}
    u = {f: {v: absent[f] / 2 + k + 0.5 for k, v in enumerate(order)} for f, order in (("a", ["v0", "v2", "v1"]), ("b", ["v1", "v0", "v3"]))}
    dense = pd.DataFrame(u).reindex(["v0", "v1", "v2", "v3"]).fillna(0.0)
    assert [g[:2] for g in got] == [("a", "b")] and got[0][2] == pytest.approx(dense.corr().loc["a", "b"], abs=1e-9)


def test_no_rows(spark):
    assert screen.spearman_matrix(spark.createDataFrame([], "visit_id string, feature string, value double")).count() == 0


def test_nothing_as_long_as_the_features_is_written(spark, monkeypatch):
    """Ranks move as blocks: lists of visits and pieces of blocks are written, no row for each value."""
    rows = [(f"v{i}", f"f{j:02d}", float((i * 7 + j * 3 + i * j) % 50 + 1)) for i in range(200) for j in range(20)]
    feats = materialize(spark.createDataFrame(rows, "visit_id string, feature string, value double").coalesce(1), "features")
    written = []

    def kept(df, name="stage"):
        stored = materialize(df, name)
        written.append((name, stored.count()))
        return stored

    for module in (screen, ranking, rank_blocks):
        monkeypatch.setattr(module, "materialize", kept)
    assert screen.spearman_matrix(feats).count() == 190
    assert max(n for _, n in written) < len(rows) / 4, written
