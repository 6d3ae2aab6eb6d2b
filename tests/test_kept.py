"""What is kept between runs: laid-out tables, quantile sketches, stream state."""

import json
import os
import random
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F

from visitloom.operators import sketches
from visitloom.plans import models
from visitloom.plans.kept import bucketed_totals
from visitloom.sources import layout
from visitloom.streaming import baseline

TARGETS = ("updrs_1", "updrs_2")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def arriving():
    folder = tempfile.mkdtemp(prefix="arriving-")

    class Source:
        path, sink, checkpoint, n = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", 0

        def send(self, rows, extra=()):
            os.makedirs(self.path, exist_ok=True)
            self.n += 1
            lines = [
                json.dumps({"patient_id": p, "visit_month": m, **{t: s for t, s in zip(TARGETS, scores) if s is not None}})
                for p, m, scores in rows
            ]
            with open(f"{folder}/{self.n}.tmp", "w") as f:
                f.write("\n".join([*lines, *extra]) + "\n")
            os.rename(f"{folder}/{self.n}.tmp", f"{self.path}/{self.n}.txt")

        def run(self, spark, wait_ms=86_400_000, files=10):
            visits = baseline.arriving_scores(spark, self.path, TARGETS, files)
            baseline.run_available(baseline.changes(visits, TARGETS, wait_ms), self.sink, self.checkpoint)
            return self.read(spark)

        def read(self, spark):
            rows = spark.read.schema(baseline.CHANGES).parquet(self.sink).collect()
            return sorted((r["visit_id"], r["target"], r["change"]) for r in rows)

    return Source()


def wanted(rows):
    """Changes by plain Python, each month of a patient once."""
    first = {}
    for p, m, scores in rows:
        first.setdefault((p, m), scores)
    out = []
    for (p, m), scores in first.items():
        for t, s, b in zip(TARGETS, scores, first.get((p, 0), [None] * len(TARGETS))):
            out.append((f"{p}_{m}", t, None if s is None or b is None else s - b))
    return sorted(out, key=str)


def test_shuffled_and_repeated_files_give_the_batch(spark, arriving):
    rng = random.Random(1)
    rows = [(p, m, [rng.choice([None, *range(30)]) for _ in TARGETS]) for p in range(12) for m in (0, 3, 6, 12, 24)]
    sent = rows * 2
    rng.shuffle(sent)
    for i in range(0, len(sent), 30):
        arriving.send(sent[i : i + 30])
    got = arriving.run(spark, files=1)
    assert sorted(got, key=str) == wanted(rows)


def test_a_rerun_goes_on_with_the_state(spark, arriving):
    arriving.send([(1, 6, [5, 7]), (2, 0, [1, None])])
    assert [r[0] for r in arriving.run(spark)] == ["2_0", "2_0"]
    arriving.send([(1, 0, [2, 2]), (1, 6, [5, 7]), (2, 12, [4, 4])])
    got = arriving.run(spark)
    assert sorted(got, key=str) == wanted([(1, 6, [5, 7]), (2, 0, [1, None]), (1, 0, [2, 2]), (2, 12, [4, 4])])


def test_visits_without_month_0_go_out_after_the_time_limit(spark, arriving):
    arriving.send([(1, 6, [5, 7])])
    arriving.send([(3, 0, [1, 1])])
    assert [r[0] for r in arriving.run(spark, wait_ms=1)] == ["3_0", "3_0"]
    time.sleep(0.1)
    arriving.send([(4, 0, [1, 1])])
    got = arriving.run(spark, wait_ms=1)
    assert [r for r in got if r[0] == "1_6"] == [("1_6", t, None) for t in TARGETS]
    arriving.send([(1, 0, [2, 2]), (1, 6, [5, 7]), (1, 12, [5, 7])])
    got = arriving.run(spark, wait_ms=1)
    # the month that went out isn't repeated; later ones know month 0
    assert [r[2] for r in got if r[0] == "1_6"] == [None, None]
    assert [r[2] for r in got if r[0] == "1_12"] == [3, 5]


def test_lines_that_are_no_visits_are_left_out(spark, arriving):
    arriving.send([(1, 0, [2, 3])], ["", "{broken", '{"visit_month": 3}', '{"patient_id": 5}', '"text"'])
    assert arriving.run(spark) == [("1_0", t, 0) for t in TARGETS]


def test_sketches_merge_to_the_stated_error(spark):
    # two targets over 24 months, one of them skewed and with ties, far more scores than a sketch keeps
    scores = spark.range(72000).select(
        F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("target"),
        (F.floor(F.col("id") / 3) % 24).cast("int").alias("visit_month"),
        F.when(F.col("id") % 3 == 0, F.xxhash64("id") % 1000).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)) * F.pmod(F.xxhash64("id"), F.lit(7)))
        .cast("int").alias("score"),
    )
    table = sketches.monthly(scores)
    assert table.count() == 48
    windows = {"first": (0, 11), "all": (0, 23), "none": (30, 40)}
    rows = sketches.compared(scores, table, windows, {"low": 0.1, "mid": 0.5, "high": 0.95}).collect()
    assert {(r["target"], r["window"], r["n"]) for r in rows} == {
        ("a", "first", 12000), ("a", "all", 24000), ("b", "first", 24000), ("b", "all", 48000)
    }
    assert max(max(r["low_error"], r["mid_error"], r["high_error"]) for r in rows) <= sketches.RANK_ERROR


def test_small_groups_are_exact_and_nulls_are_no_scores(spark):
    rows = [("a", 0, s) for s in (5, 1, 3, None, 2, 4)] + [("a", 1, 9), ("b", 0, None)]
    scores = spark.createDataFrame(rows, "target string, visit_month int, score int")
    got = sketches.windowed(sketches.monthly(scores), {"zero": (0, 0), "both": (0, 1)}, {"mid": 0.5, "top": 1.0})
    assert sorted(map(tuple, got.collect())) == [("a", "both", 6, 3, 9), ("a", "zero", 5, 3, 5)]
    assert sketches.windowed(sketches.monthly(scores.limit(0)), {"zero": (0, 0)}, {"mid": 0.5}).count() == 0


def stored(spark, rows, schema, buckets=4):
    return layout.write_bucketed(spark.createDataFrame(rows, schema), f"t_{uuid.uuid4().hex}", "visit_id", buckets)


def test_stored_tables_join_and_add_up_without_a_shuffle(spark):
    visits = [(f"{p}_{m}", p, m) for p in range(20) for m in (0, 6, 12)] + [(None, 99, 0)]
    features = [(f"{p}_{m}", f"f{i}", i + p / 4) for p in range(15) for m in (0, 6, 24) for i in range(5)]
    v = stored(spark, visits, "visit_id string, patient_id bigint, visit_month int")
    f = stored(spark, features, "visit_id string, feature string, value double", buckets=4)
    out = bucketed_totals(v, f)
    assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
    got = {r["visit_id"]: (r["n_prot"], r["num_prot"]) for r in out.collect()}
    sums = {}
    for visit, _, value in features:
        n, s = sums.get(visit, (0, 0))
        sums[visit] = (n + 1, s + value)
    assert got == {v[0]: sums.get(v[0], (None, None)) for v in visits}


def test_a_bucket_is_one_file_and_tables_are_not_overwritten(spark):
    name = f"t_{uuid.uuid4().hex}"
    df = spark.range(1000).select(F.col("id").cast("string").alias("visit_id"))
    table = layout.write_bucketed(df, name, "visit_id", 8)
    assert len(table.inputFiles()) == 8 and table.count() == 1000
    with pytest.raises(Exception, match="exists"):
        layout.write_bucketed(df, name, "visit_id", 8)
    assert layout.write_bucketed(df.limit(0), f"{name}_none", "visit_id", 8).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        layout.write_bucketed(df, f"{name}_zero", "visit_id", 0)


def test_bucket_counts_divide_each_other():
    counts = [layout.buckets_for(n) for n in (0, 1, 1 << 28, (1 << 28) + 1, 10 << 30, 100 << 40)]
    assert counts == [1, 1, 1, 2, 64, 1 << 19]


def test_rewritten_tables_are_read_anew(spark):
    folder = tempfile.mkdtemp(prefix="tables-")
    count = lambda: spark.read.parquet(f"{folder}/t.parquet").count()
    spark.range(5).write.parquet(f"{folder}/t.parquet")
    assert [models._once(spark, folder, "n", count) for _ in range(2)] == [5, 5]
    assert models._once(spark, folder, "n", lambda: 1 / 0) == 5
    spark.range(7).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert models._once(spark, folder, "n", count) == 7
    spark.range(1).write.parquet(f"{folder}/u.parquet")
    assert models._once(spark, folder, "n", lambda: "again") == "again"
