"""The pipeline's stages, each against a plain version on its own input."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_repetition import WORD, figures
from tests.llm.test_simhash import components, fingerprint
from visitloom.session import materialize


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, sf), name)
        out[name] = (docs.toPandas(), done.toPandas())
        if name != "best_fit_pack":
            assert done.columns == docs.columns
        docs = done
    return out


def test_names():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "best_fit_pack"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_quality(stages):
    before, after = stages["quality_rules"]
    failed = set()
    for doc_id, text in zip(before.doc_id, before.text):
        f = figures(text)
        if f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]:
            failed.add(doc_id)
        elif f["covered_words"] is not None and (f["covered_words"] > 0.3 * f["n_words"] or f["longest_repeat"] > 100):
            failed.add(doc_id)
    assert failed and set(after.doc_id) == set(before.doc_id) - failed


def test_exact(stages):
    before, after = stages["exact_dedup"]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())


def test_near(stages):
    before, after = stages["near_dedup"]
    prints = {i: fingerprint(t) for i, t in zip(before.doc_id, before.text)}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(after.doc_id) == sorted(set(want.values()))


def test_mix(stages):
    before, after = stages["source_mix"]
    assert after.doc_id.value_counts().max() <= 2
    size = before.assign(size=[len(WORD.findall(t)) for t in before.text]).set_index("doc_id")["size"]
    taken = size.loc[after.doc_id].sum()
    assert abs(taken - 1.5 * size.sum()) <= 20 * 2 * size.max() and set(after.doc_id) <= set(before.doc_id)


def test_pack(stages):
    before, after = stages["best_fit_pack"]
    assert (after.piece == 0).sum() == len(before)
    for _, part in after.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == np.r_[0, np.cumsum(part.length)[:-1]].tolist() and part.length.sum() <= 4096


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    want = stages["best_fit_pack"][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))


def test_stages_take_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            done = materialize(stage(spark, docs, sf), name)
            if name == "best_fit_pack":
                assert (done.count() == 0) == docs.isEmpty()
            else:
                assert done.columns == docs.columns
