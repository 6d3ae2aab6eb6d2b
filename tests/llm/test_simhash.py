import re

import numpy as np
import pytest
import xxhash

from visitloom.llm import simhash
from visitloom.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, shingle=3, seed=42):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    pieces = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=seed) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                a_root, b_root = find(a), find(b)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None)], [(5, 4), (4, 3), (3, 2), (9, 8), (2, 1), (4, 5)]])
def test_components_of_small_graphs(spark, edges):
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({5: 1, 4: 1, 3: 1, 2: 1, 9: 8} if len(edges) > 1 else {})


def test_components_of_random_graphs_and_a_chain(spark):
    rng = np.random.default_rng(5)
    for edges in (rng.integers(0, 120, (90, 2)).tolist(), [[i, i + 1] for i in range(200)], [[0, i] for i in range(1, 300)]):
        nodes = sorted({x for e in edges for x in e})
        linked = {tuple(e) for e in edges}
        want = components(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
        got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: r for n, r in want.items() if n != r}


def test_every_close_pair_shares_the_equal_part_of_a_chain():
    rng = np.random.default_rng(2)
    for distance, segments in ((1, 3), (2, 5), (3, 7), (4, 5)):
        chains, equal = simhash.ring(distance, segments)
        assert equal * distance // segments == 0
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            assert any(
                all((x & c[n - 1]).bit_count() <= n * distance // segments for n in range(1, segments + 1)) for c in chains
            )


@pytest.mark.parametrize("pairwise", [2, 2048])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_connect_what_is_close(spark, distance, pairwise):
    rng = np.random.default_rng(distance)
    values = set()
    for center in rng.integers(0, 2**63, 6):
        values.add(int(center))
        for _ in range(60 if distance < 3 else 12):
            flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            values.add(int(center) ^ flip)
    values = sorted({v - 2**64 if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    got = simhash.links(df, distance, pairwise=pairwise).collect()
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance
    pairs = {(r["a"], r["b"]) for r in got}
    assert components(values, lambda a, b: (a, b) in pairs or (b, a) in pairs) == components(values, close)


def test_links_of_a_large_group_stay_few(spark):
    values = [sum(1 << b for b in range(64) if b > 40 and n >> (b - 41) & 1) for n in range(3000)]
    values = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.links(df, 2, pairwise=4096).count() <= simhash.SEGMENTS * len(values)


def test_near_duplicates(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(i, " ".join(f"v{j}" for j in rng.integers(0, 9999, 50))) for i in range(40)]
    for i in range(40, 80):
        words = list(base)
        words[int(rng.integers(0, 400))] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(80, "Two Words"), (81, "two\twords"), (82, ""), (83, None), (84, " \n"), (85, "a A a A a"), (86, "ÄÖ äö x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, carry=["doc_id"]).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    want = components([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(df).collect())
    assert kept == sorted(set(want.values()))


def test_odd_rows(odd, none):
    full = simhash.near_duplicates(odd)
    assert full.columns == [*odd.columns, "fingerprint", "component_id"] and full.count() == odd.count()
    empty = [r for r in full.collect() if not (r["text"] or "").strip()]
    assert {(r["fingerprint"], r["component_id"]) for r in empty} == {("0" * 16, 2)}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 6, 7, 8, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0
    with pytest.raises(ValueError):
        simhash.links(odd.selectExpr("at as fp"), 5)


def test_query_fingerprints(spark, sf, documents):
    import __spark_entry__ as entry

    got = entry.queries()["op7_pigeonring"](spark, sf).toPandas().set_index("doc_id")
    prints = {i: fingerprint(t) for i, t in zip(documents.doc_id, documents.text)}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got.fingerprint.to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    assert got.component_id.to_dict() == want
