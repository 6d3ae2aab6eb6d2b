import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By resharing until no target is above its limit; ``sizes`` in source order."""
    budget, full, out = share * sum(sizes), {}, {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i % len(weights)] for i in open_)
        left = budget - sum(full.values())
        out = {i: left * weights[i % len(weights)] / weight for i in open_}
        above = {i: most * sizes[i] for i, t in out.items() if t > most * sizes[i]}
        if not above:
            return [full.get(i, out.get(i)) for i in range(len(sizes))]
        full |= above


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 50, 7, 0], [0, 0], [5, 5, 5, 5, 5, 5], [1, 1, 1000000]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = [(n, s - s // 3) for n, s in zip(names, sizes)] + [(n, s // 3) for n, s in zip(names, sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert [got[n] for n in names] == pytest.approx(targets(sizes), abs=1e-6)


def test_copies_cross_integer_boundaries(spark):
    rng = np.random.default_rng(4)
    units = rng.integers(0, 2 * mixing.UNIT, 500)
    rows = [("a" if i % 3 else None, int(i), int(u)) for i, u in enumerate(units)]
    df = spark.createDataFrame(rows, "g string, i long, u long").repartition(7)
    got = {r["i"]: r["copies"] for r in mixing.systematic_copies(df, "g", "u", ["i"]).collect()}
    offsets = {r["g"]: r["o"] for r in df.select("g", mixing.random_offset("g", "mix").alias("o")).distinct().collect()}
    assert all(0 <= o < mixing.UNIT for o in offsets.values()) and len(set(offsets.values())) == 2
    for g, start in offsets.items():
        at = start
        for _, i, u in (r for r in rows if r[0] == g):
            assert got[i] == (at + u) // mixing.UNIT - at // mixing.UNIT
            at += u


def mixed_frame(spark, n=600):
    rng = np.random.default_rng(0)
    rows = [
        (i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "b", "a", "hot"][min(3, int(rng.integers(0, 9)))])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_words_come_near_the_target(spark):
    df = mixed_frame(spark)
    got = mixing.mix(df, mixing.n_words(F.col("text")), carry=["doc_id", "source"])
    first = sorted(map(tuple, got.collect()), key=str)
    again = mixing.mix(df.repartition(9), mixing.n_words(F.col("text")), carry=["doc_id", "source"])
    assert first == sorted(map(tuple, again.collect()), key=str)
    pdf = got.toPandas()
    pdf["source"] = pdf.source.fillna("~")
    assert (pdf.copies <= 2).all() and pdf.copies.min() >= 0
    for _, part in pdf.groupby("source"):
        assert part["size"].sum() == part.source_size.iloc[0]
        assert abs((part.copies * part["size"]).sum() - part.target.iloc[0]) <= 2 * part["size"].max()
    sizes = pdf.groupby("source")["size"].sum()
    assert pdf.groupby("source").target.first().tolist() == pytest.approx(targets(sizes.tolist()))


def test_mixed_repeats_whole_rows(spark):
    df = mixed_frame(spark, 200)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df, mixing.n_words(F.col("text"))).collect()}
    out = mixing.mixed(df, mixing.n_words(F.col("text")))
    assert out.columns == df.columns
    got = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {i: c for i, c in copies.items() if c}


def test_odd_rows(odd, none):
    got = mixing.mix(odd, mixing.n_words(F.col("text")))
    assert got.columns == [c for c in odd.columns if c != "size"] + ["size", "source_size", "target", "copies"]
    rows = got.collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["text"] is None} == {0}
    assert {(r["source"], r["source_size"]) for r in rows} == {("a", 15), ("b", 5), ("c", 30002), (None, 6)}
    assert mixing.mixed(odd, mixing.n_words(F.col("text"))).columns == odd.columns
    assert mixing.mix(none, mixing.n_words(F.col("text"))).count() == 0
    assert mixing.mixed(none, mixing.n_words(F.col("text"))).count() == 0
