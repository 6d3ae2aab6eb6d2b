"""Removal of repeated byte strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import COLUMNS, ODD, padded
from visitloom.llm import queries, substrings


def plain(texts, length):
    """(n_bytes, spans, sha) of each text, by counting all strings of the length."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter()
    for b in bodies:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        spans = substrings._merged([(i, i + length) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1])
        kept, at = b"", 0
        for start, end in [*spans, (len(b), len(b))]:
            kept, at = kept + b[at:start], end
        out.append((len(b), tuple(spans), hashlib.sha256(kept).hexdigest(), kept))
    return out


def got(df):
    return sorted(
        (r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), r["kept_sha256"])
        for r in df.select("doc_id", "n_bytes", "removed", "kept_sha256").collect()
    )


def want(rows, length):
    return sorted((r[0], *p[:3]) for r, p in zip(rows, plain([r[1] for r in rows], length)))


def frame(spark, texts, parts=4):
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def passages(seed, n, words=300):
    """Texts that share passages at odd places, some of them copies of another or periodic."""
    rng = random.Random(seed)
    vocabulary = [f"{chr(97 + i % 26)}{i}é"[: 2 + i % 5] for i in range(words)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.choice([20, 60, 200]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.choice([1, 2, 4])):
            parts.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 30]))))
            p = rng.choice(shared)
            a, b = sorted(rng.choices(range(len(p)), k=2))
            parts.append(p[a:b])
        texts.append(rng.choice([" ".join(parts), " ".join(parts), texts[-1] if texts else "", "ab" * rng.choice([10, 90, 140])]))
    return texts


@pytest.mark.parametrize("seed, length, gram, least_run", [(1, 40, 8, 1024), (2, 25, 12, 3), (3, 200, 48, 2), (4, 60, 16, 5)])
def test_shared_passages(spark, seed, length, gram, least_run):
    rows, docs = frame(spark, passages(seed, 150))
    done = got(substrings.without_repeats(docs, length, gram=gram, least_run=least_run))
    assert done == want(rows, length)
    assert any(r[2] and r[2] != ((0, r[1]),) for r in done)


def test_query(spark, sf, documents):
    rows = list(zip(documents.doc_id, documents.text))
    expected = {(r[0], r[1], sum(b - a for a, b in r[2]), len(r[2]), r[3]) for r in want(rows, 200)}
    done = queries.op12(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(done) == len(rows) and {tuple(r) for r in done} == expected
    assert 0 < sum(r["n_removed"] > 0 for r in done) < len(rows)


def test_odd_rows(spark, odd, none):
    rows = [r for r in ODD]
    done = substrings.without_repeats(odd, 50, gram=16)
    assert done.count() == len(rows) and set(odd.columns) <= set(done.columns)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    have = [(r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), r["kept_sha256"]) for r in done.collect()]
    assert sorted(have, key=key) == sorted(((r[0], *p[:3]) for r, p in zip(rows, plain([r[1] for r in rows], 50))), key=key)
    assert substrings.without_repeats(none).count() == 0


def test_text(spark):
    rows, docs = frame(spark, passages(5, 40))
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substrings.without_repeats(docs, 40, with_text=True, gram=8).collect()}
    assert kept == {r[0]: p[3] for r, p in zip(rows, plain([r[1] for r in rows], 40))}


def test_text_longer_than_a_block(spark):
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, substrings.BLOCK + 5000)))
    cut = substrings.BLOCK
    rows, docs = frame(spark, [long, long[cut - 300 : cut + 300], "x" * 300 + long[100:250], "x" * 450])
    done = got(substrings.without_repeats(docs, 200))
    assert done[0][2] == ((cut - 300, cut + 300),) and done[1][2] == ((0, 600),)
    assert done[2][2] == ((0, 300),) and done[3][2] == ((0, 450),)


def test_hot_passage_and_copies(spark):
    """A third of all rows share a passage behind differing texts, a third are copies."""
    rng = random.Random(3)
    passage = " ".join(str(rng.random()) for _ in range(20))
    texts = []
    for i in range(600):
        own = "".join(rng.choices("abcdef ", k=120))
        texts.append([own + passage[: rng.choice([150, 230, 300])] + own[::-1], "copy of " + passage, own * 2][i % 3])
    rows, docs = frame(spark, texts, 8)
    assert got(substrings.without_repeats(docs, 100, gram=24, least_run=20)) == want(rows, 100)


def test_equal_strings_hold_a_sample_at_one_distance():
    rng = np.random.default_rng(4)
    length, gram = 60, 16
    passage = rng.integers(97, 101, 90).astype(np.uint8)
    places = []
    for before in (0, 13, 57):
        data = np.concatenate([rng.integers(97, 123, before), passage, rng.integers(97, 123, 80)]).astype(np.uint8)
        _, _, start, place, n = substrings._samples_of(data, np.array([0]), np.array([len(data)]), length, gram)
        by_start = {s + i: p for s, p, k in zip(start, place, n) for i in range(k)}
        places.append([by_start[before + i] - before for i in range(len(passage) - length + 1)])
    assert places[0] == places[1] == places[2]


def test_triples_sort_like_the_strings():
    rng = np.random.default_rng(5)
    strings = rng.integers(0, 3, (500, 40)).astype(np.uint8)
    of = np.sort(rng.integers(0, 4, 500))
    order, shared = substrings._sorted(strings, of)
    keys = [(of[i], strings[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 500):
        (a, x), (b, y) = keys[i - 1], keys[i]
        same = next((j for j in range(40) if x[j] != y[j]), 40)
        assert shared[i] == (same if a == b else -1)
