import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visitloom.llm import content_sort


def brute(rows, keep, change=lambda t: t):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(change(text or ""), []).append(doc_id)
    pick = max if keep == "max" else min
    out = []
    for doc_id, text in rows:
        own = groups[change(text or "")]
        real = [i for i in own if i is not None]
        out.append((doc_id, pick(real) if real else None, len(own), hashlib.sha256(change(text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("least_run", [1, 64])
def test_groups_also_where_one_text_is_split(spark, monkeypatch, keep, least_run):
    monkeypatch.setattr(content_sort, "LEAST_RUN", least_run)
    rows = [(i, "hot " * 20 if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    rows += [(None, "hot " * 20), (None, None), (900, ""), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = content_sort.content_groups(df, keep=keep, carry=["doc_id"]).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows, keep)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_normalised_texts(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a  b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = content_sort.content_groups(df, normalise=F.lower).collect()
    assert {(r["doc_id"], r["keep_id"], r["text"]) for r in got} == {(1, 1, "A b"), (2, 1, "a B"), (3, 3, "a  b"), (4, 4, None)}


def test_only_one_of_repeated_rows_stays(odd, none):
    kept = content_sort.deduplicated(odd, keep="max")
    assert kept.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    texts = [t for _, t in got]
    assert len(texts) == len({t or "" for t in texts}) == len({r["text"] or "" for r in odd.collect()})
    assert (5, "plain words in a row") in got and (3, "") in got
    assert content_sort.deduplicated(none).count() == 0
    full = content_sort.content_groups(odd)
    assert full.columns == [c for c in odd.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert full.count() == odd.count()


def test_rows_that_differ_elsewhere_only(spark):
    rows = [(1, "same", "x"), (1, "same", "y"), (None, "same", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["doc_id"] for r in content_sort.deduplicated(df).collect()] == [1]
    alone = spark.createDataFrame([(None, "t", "x"), (None, "t", "y")], "doc_id long, text string, source string")
    assert content_sort.deduplicated(alone).count() == 1
