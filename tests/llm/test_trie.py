"""The prefix trie against a plain dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string"


def n_words(text):
    return len(text.encode().split())


def plain(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]} or pairs, by brute force."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for conv, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                words[tuple(turns[:d])] = n_words(turns[d - 1][1])
        ends[tuple(turns)].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, own in members.items():
        below = [u for u in members if u[: len(node)] == node]
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]),
            sum(not children[u] for u in below), sum((len(members[u]) - 1) * words[u] for u in below),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def ordered(rows):
    """{conv_id: turns} of table rows."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def frame(spark, conversations):
    rows = [(c, [{"role": r, "text": t} for r, t in turns]) for c, turns in conversations]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>")
    return df.withColumn("turns", F.transform("turns", lambda t: trie.turn_struct(t["role"], t["text"]))).repartition(4)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_findclose():
    rng = random.Random(2)
    for n in (1, 2, 31, 500, 4000):
        signs, opened, left = [], 0, n
        while left or opened:  # often deep, often flat
            up = left and (not opened or rng.random() < rng.choice([0.3, 0.5, 0.7]))
            signs.append(1 if up else -1)
            opened, left = (opened + 1, left - 1) if up else (opened - 1, left)
        stack, want = [], {}
        for i, s in enumerate(signs):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = trie.Parentheses(np.array(signs))
        assert tree.findclose(tree.opens).tolist() == [want[i] for i in tree.opens.tolist()]


@pytest.mark.parametrize("seed, shard_turns", [(1, 5), (2, 40), (3, 1), (4, 100_000)])
def test_random_conversations(spark, seed, shard_turns):
    rng = random.Random(seed)
    turn = [("user" if i % 2 else "assistant", "w " * i) for i in range(4)]
    conversations = [
        (1000 - i, [rng.choice(turn[: rng.choice([1, 2, 4])]) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))])
        for i in range(250)
    ]
    assert got(trie.prefix_trie(frame(spark, conversations), shard_turns=shard_turns)) == plain(conversations)


def test_long_conversation_and_copies(spark):
    long = [("user", f"turn {i}") for i in range(700)]
    conversations = [(i, long if i % 3 else long[: i + 1] + [("user", "else")]) for i in range(30)] + [(7, [])]
    assert got(trie.prefix_trie(frame(spark, conversations), shard_turns=1000)) == plain(conversations)


ODD = [
    (1, 2, "user", "b"), (1, None, "user", "first, without turn"), (1, 1, None, None), (1, 1, None, None),
    (20, 0, "user", "  many   words\there "), (20, 1, None, "x"), (20, 2, "a", ""), (20, 3, "a", "end"),
    (21, 0, "user", "own"), (25, 0, "user", "own"), (27, 5, "u", "long " * 20000), (None, 1, "user", "nobody's"),
    (40, 0, "", None), (42, 0, "us", "er:x"), (43, 0, "user", ":x"), (-3, 0, "user", "own"), (-20, 1, "q", "z"),
]


def test_odd_turns(spark):
    rows = spark.createDataFrame(ODD, COLUMNS).withColumn("n", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    turns = trie.numbered_turns(rows)
    each = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn"))), lambda t: t["turn"]).alias("turns"))
    want = ordered(ODD)
    assert got(trie.prefix_trie(each)) == plain(want.items())
    assert want[1][0] == ("user", "first, without turn")


def rebuilt(conversations):
    out = []
    for c, turns in conversations.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out.append((c, conversations.get(base, [])[:h] + turns[h:]))
    return out


def test_query(spark, sf):
    import pandas as pd

    table = pd.read_parquet(f"{sf}/conversations.parquet")
    rows = [tuple(None if v != v else v for v in r) for r in table[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert got(queries.op11(spark, sf)) == plain(rebuilt(ordered(rows)))
    turns = trie.numbered_turns(spark.createDataFrame(ODD, COLUMNS))
    want = rebuilt(ordered(ODD))
    assert any(not t for _, t in want)
    assert got(trie.prefix_trie(queries.rebuilt(turns))) == plain(want)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], f"conv_id long, turns {trie.TURNS}")
    df = trie.prefix_trie(none)
    assert df.count() == 0
    rows = spark.createDataFrame([(3, None), (2, None), (None, None)], f"conv_id long, turns {trie.TURNS}")
    assert got(trie.prefix_trie(rows)) == plain([(3, []), (2, [])])
