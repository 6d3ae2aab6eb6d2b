import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from visitloom.llm import simple8b
from visitloom.session import fresh_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@given(
    st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=400),
    st.sampled_from([1, 2, 7, 256]),
    st.integers(0, 400),
    st.integers(0, 400),
)
@settings(max_examples=300, deadline=None)
def test_round_trip(ids, block, a, b):
    ids = np.array(ids, np.uint64)
    payload = simple8b.encode(ids, np.array([len(ids)]), block)
    assert simple8b.decode(payload).tolist() == ids.tolist()
    assert simple8b.decode(payload, a, b).tolist() == ids[a:b].tolist()


def test_words_hold_what_the_selectors_say():
    for count, bits in simple8b.SELECTORS[1:]:
        ids = np.full(count, (1 << bits) - 1, np.uint64)
        _, n, (_, _, words, escapes) = simple8b.read(simple8b.encode(ids, np.array([count])))
        assert n == count and len(words) == 1 and len(escapes) == 0
    _, _, (lengths, starts, words, escapes) = simple8b.read(simple8b.encode(np.array([2**60, 1], np.uint64), np.array([2, 0])))
    assert len(escapes) == 1 and escapes[0] == 2**60 and lengths.tolist() == [2, 0] and starts.tolist() == [0] and len(words) == 2
    with pytest.raises(ValueError):
        simple8b.read(b"XXXX" + bytes(44))


def expected(rows, end=0):
    plain, at, out = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_documents_in_order(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(300, 0, -1)] + [(0, None), (-5, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = fresh_path(spark, "ids")
    simple8b.write(df, folder, BYTES, True, 0)
    got = sorted(map(tuple, simple8b.documents(spark, folder).collect()))
    assert got == expected(sorted(rows))


def test_odd_rows(spark, odd, none):
    folder = fresh_path(spark, "ids")
    simple8b.write(odd, folder, BYTES, True, 0)
    got = simple8b.documents(spark, folder).collect()
    assert len(got) == odd.count()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r["start"] for r in order] == np.r_[0, np.cumsum([r["n_tokens"] for r in order])[:-1]].tolist()
    known = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got}
    assert {(i, n, c) for i, _, n, c in expected([(r["doc_id"], r["text"]) for r in odd.collect()])} == known
    folder = fresh_path(spark, "ids")
    simple8b.write(none, folder, BYTES, True, 0)
    assert simple8b.documents(spark, folder).count() == 0


def test_query(spark, sf, documents):
    import __spark_entry__ as entry

    got = sorted(map(tuple, entry.queries()["op10_simple8b"](spark, sf).collect()))
    assert got == expected(sorted(zip(documents.doc_id, documents.text)))
