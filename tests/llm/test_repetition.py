import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from visitloom.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_shared(words):
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def figures(text, least=16):
    words = WORD.findall(text or "")
    shared = naive_shared(words) if len(words) < 400 else None
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    covered = None if shared is None else {i + k for i, n in enumerate(shared) if n >= least for k in range(n)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "covered_words": None if covered is None else len(covered),
        "longest_repeat": None if shared is None else max(shared, default=0),
    }


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=5))
@settings(max_examples=200, deadline=None)
def test_longest_shared_prefixes(texts):
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(int)
    symbols = np.array([10 * i + s for i, t in enumerate(texts) for s in t], np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    want = [n for t in texts for n in naive_shared(t)]
    assert repetition.longest_shared(symbols, ends).tolist() == want


def test_figures_and_spans(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 2, 3, 10, 60)]
    texts += ["a b c d\n\n a b c d\na b c d\n#$ x", None, "", "one two " * 40, "ß日 本 ß日 本"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in repetition.repetition(df, least_repeat=4).collect():
        want = figures(texts[r["doc_id"]], 4)
        assert {k: r[k] for k in want} == want
        inside = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(inside) == r["covered_words"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_spans_stop_at_the_end_of_a_text(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "c d c d")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repetition.repetition(df, least_repeat=2).collect()}
    assert got == {1: [(0, 4)], 2: [(0, 4)]}


def test_rules_take_repetitive_texts_and_leave_clean_ones(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(150))
    spread = " ".join(f"q{i}" for i in range(900))
    texts = [clean, f"{clean} {passage} {spread} {passage}", "too short", (clean + " ") * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.judged(df).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, False, False, False]
    assert [got[i]["base_failed"] for i in range(4)] == [False, False, True, True]
    assert got[1]["longest_repeat"] == 150 and got[1]["repetitive"]
    assert [r["doc_id"] for r in repetition.accepted(df).collect()] == [0]


def test_short_passages_between_base_and_limit(spark):
    def mixed(length, times, n):
        """``n`` words, of which one passage of ``length`` words comes ``times`` times, spread."""
        fresh, gap = iter(f"w{i}" for i in range(n)), (n - length * times) // times
        return " ".join(" ".join([f"p{i}" for i in range(length)] + [next(fresh) for _ in range(gap)]) for _ in range(times))

    cases = [(12, 15, 400), (5, 12, 200), (9, 4, 160), (5, 2, 200), (9, 2, 150), (16, 2, 400), (15, 4, 400), (4, 40, 400)]
    df = spark.createDataFrame([(i, mixed(*c)) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.judged(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(len(cases))] == [False, False, False, True, True, True, False, True]
    for i, r in got.items():
        shared = naive_shared(mixed(*cases[i]).split())
        want = [len({a + k for a, n in enumerate(shared) if n >= least for k in range(n)}) for least in repetition.GRADES]
        assert r["graded_words"] == want
    loose = repetition.judged(df, grades={}).where("kept").count()
    assert loose == len(cases)


def test_odd_rows(odd, none):
    rows = repetition.judged(odd, carry=["doc_id", "text", "kept"]).collect()
    assert len(rows) == odd.count()
    assert {r["n_words"] for r in rows if r["text"] is None} == {0}
    assert max(r["n_words"] for r in rows) == 30001
    assert repetition.accepted(odd).columns == odd.columns
    assert [r["doc_id"] for r in repetition.accepted(odd).collect()] == [7]
    assert repetition.judged(none).count() == 0


def test_blocks_hold_whole_texts():
    import pyarrow as pa

    texts = pa.array(["aa", None, "b" * 50, "", "c"])
    parts = list(repetition.blocks(texts, 10))
    assert pa.concat_arrays(parts).to_pylist() == texts.to_pylist() and len(parts) == 3


@pytest.mark.parametrize("least", [16])
def test_query(spark, sf, documents, least):
    got = entry.queries()["op1_suffix_repeats"](spark, sf).toPandas().set_index("doc_id")
    for doc_id, text in zip(documents.doc_id, documents.text):
        want, r = figures(text, least), got.loc[doc_id]
        assert all(r[k] == v for k, v in want.items() if v is not None)
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.base_failed and r.kept)
