import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from visitloom.llm import packing
from visitloom.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

STRANGE = [
    "", " ", "   ", "  a  b ", "a\n b", "x  y z\n", "don't it's abc123def <|endoftext|> foo<|startoftext|>bar",
    "İstanbul ΟΔΟΣ é ﬁ", "\x1c a\x1db c\x0bd\x85e  f", " lead", "trail ", "a  b\t c\r\n d", "don 't 's", "tab\tx y　z w",
    "日本語 テキスト 👍🏽 ok", "a" * 3000 + " " + "é" * 200, " 's 'll", "Ġ ĠĠ a</w> b", "é ́x", "= == | ~",
]


@pytest.fixture(scope="module", params=[(WORDS, False), (BYTES, True)], ids=["words", "bytes"])
def both(request):
    path, spaced = request.param
    return Encoder(path, spaced), Tokenizer.from_file(path)


def same(coder, plain, texts):
    ids, offsets = coder.encode(pa.array(texts, pa.string()), 7)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [7], repr(text)


def test_ids_of_strange_texts(both):
    same(*both, [*STRANGE, None])
    same(*both, STRANGE[::-1])


@given(st.lists(st.text(st.sampled_from("ab 'sé\n\t  =.,1<|>İ👍"), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_library(both, texts):
    same(*both, texts)


def test_ids_of_words_that_normalising_changes(both):
    """Words whose letters are composed, taken apart or marked, many in one call of the library."""
    rng = random.Random(0)
    letters = list("abXYZéÉßÿÑÖİıſΩ日.,;'!#<|>/-_09€…’\u0301\u200d×ªµº") + ["don't", "word's", "<|endoftext|>", "ÀÉ'.", "Zß!?"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(6000)]
    same(*both, [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)])


@pytest.mark.parametrize("most", [3, 40])
def test_the_cache_is_emptied(both, monkeypatch, most):
    monkeypatch.setattr("visitloom.llm.tokens.CACHED_UNITS", most)
    for text in STRANGE:
        same(*both, [text])


def by_items(lengths, capacity):
    """Sequences that best fit, longest first, opens item by item."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@given(st.lists(st.integers(1, 30), max_size=120))
@settings(max_examples=300, deadline=None)
def test_plan_is_best_fit_over_counts(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed, seen = {}, {n: 0 for n in counts}
    for length, rank, n, each, first, offset in packing.plan(counts, 30):
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            placed.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert seen == counts
    for slots in placed.values():
        slots.sort()
        assert [o for o, _ in slots] == np.r_[0, np.cumsum([n for _, n in slots])[:-1]].tolist()
    assert sorted(30 - sum(n for _, n in s) for s in placed.values()) == by_items(lengths, 30)


def test_plan_stays_small():
    rows = packing.plan({n: 10**9 + n for n in range(1, 4097)}, 4096)
    assert len(rows) < 30_000


@pytest.mark.parametrize("slots", [3, 100_000])
def test_pieces_and_places(spark, monkeypatch, slots):
    monkeypatch.setattr(packing, "SLOTS_PER_ROW", slots)
    plain = Tokenizer.from_file(WORDS)
    texts = [None, "", *(["one two"] * 200), "word " * 100, "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = packing.pack(df, WORDS, False, 1, capacity=16, with_ids=True, carry=["doc_id"]).collect()
    for r in got:
        ids = np.array(plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        own = ids[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["start"] == 16 * r["piece"] and bytes(r["ids"]) == own and r["ids_crc32"] == zlib.crc32(own)
    assert sum(r["length"] for r in got) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots_ in places.values():
        at = 0
        for offset, n in sorted(slots_):
            assert offset == at
            at += n
        assert at <= 16
    assert len(places) == len(by_items([r["length"] for r in got], 16))


def test_odd_rows(odd, none):
    got = packing.pack(odd, WORDS, False, 1)
    assert got.columns == [*odd.columns, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert len([r for r in rows if r["piece"] == 0]) == odd.count()
    assert {r["length"] for r in rows if not (r["text"] or "").strip()} == {1}
    assert all(r["length"] == 4096 for r in rows if r["piece"] == 0 and r["doc_id"] == 7)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    empty = packing.pack(none, WORDS, False, 1)
    assert empty.columns == got.columns and empty.count() == 0
