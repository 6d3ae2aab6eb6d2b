"""Source divergence against a plain count of all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import COLUMNS, ODD, padded
from visitloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, least_docs, top):
    """Rows (lang, source, part, item, value, rank) of documents (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(count):
            space = sum(count.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // space for t, n in count.items()}

        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in sources:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_small_table(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    want = plain(zip(documents.text, documents.lang, documents.source), 5, 20)
    assert got(divergence.divergence(docs, least_docs=5, top_terms=20)) == want


def test_more_sources_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    texts = [f"Alpha beta{'x' * (i % 4)} gamma, gamma. delta-delta {'rest ' * (i % 3)}w{i % 5}" for i in range(60)]
    rows = padded(*[(i, t, "en" if i % 4 else "de", f"s{i % 11:02d}") for i, t in enumerate(texts)])
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert got(divergence.divergence(docs, least_docs=2)) == plain([r[1:4] for r in rows], 2, 50)


def test_odd_rows(odd):
    want = plain([r[1:4] for r in ODD], 1, 50)
    assert got(divergence.divergence(odd, least_docs=1)) == want
    assert any(r[0] == "" for r in want)


def test_no_term_is_common(odd):
    rows = got(divergence.divergence(odd, least_docs=1000))
    assert rows and {r[4] for r in rows} == {0} and {r[2] for r in rows} == {"pair"}


def test_empty_table(none):
    df = divergence.divergence(none)
    assert df.count() == 0 and df.columns == ["lang", "source", "part", "item", "value", "rank"]


NUMBERED = "lang_no int, number int, text string"


def test_chunks_of_one_term_in_one_document(spark):
    rows = [(1, i % 2, "Same/same same; one") for i in range(40)] + [(1, 0, "(one)")]
    docs = spark.createDataFrame(rows, NUMBERED)
    counts = {(r["term"], r["number"]): r["n"] for r in divergence.term_counts(docs, 40).collect()}
    assert counts == {("same", 0): 60, ("same", 1): 60, ("one", 0): 21, ("one", 1): 20}
    assert divergence.term_counts(docs, 42).count() == 0


def test_runs_are_merged_as_they_are_read(spark, monkeypatch):
    least, rng = 5, np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "A.", "c,", "d"], 9, p=[0.6, 0.1, 0.1, 0.1, 0.1])) for _ in range(300)]
    batches = []
    for i, text in enumerate(texts):
        batches.append(divergence._block(np.array([i % 2]), np.array([i % 3]), pa.array([text]), i << 24, least).batch())
    table = pa.Table.from_batches(batches).sort_by("key")
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 50)
    merged = list(divergence._by_key(least, True, lambda rows: rows.batch())(table.to_batches(max_chunksize=20)))
    got = divergence.Counts.of(pa.Table.from_batches(merged).combine_chunks().to_batches()[0])
    want = {(w, k): sum(w in t.split() for t in texts[k::2]) for k in (0, 1) for w in ("a", "b", "A.", "c,", "d")}
    names = got.names.to_pylist()
    assert {(names[k], g): n for k, g, n in zip(got.key, got.lang, got.n_docs)} == want
    assert got.n.sum() == 9 * len(texts)


@pytest.mark.parametrize("text", ["naïve Ärger straße 日本 x y", "\x0b\x0c\r a\x85b", "1a2B3"])
def test_terms(spark, text):
    docs = spark.createDataFrame([(0, 0, text)], NUMBERED)
    found = {r["term"]: r["n"] for r in divergence.term_counts(docs, 1).collect()}
    assert found == Counter(t.translate(LOWER) for t in TERM.findall(text))
