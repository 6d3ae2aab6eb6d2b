import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import langid

STEMS = {
    "en": "the and that with this from have which their would there about".split(),
    "de": "der und die nicht eine mit für über zwischen können würde schön".split(),
    "fr": "les des une dans pour que avec être très où français même".split(),
    "es": "los las una para que con está más señor año también niño".split(),
    "fi": "ja että olen tämä mikä kuin myös mutta sitten hyvä päivä yötä".split(),
}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [
        (i * len(STEMS) + j, " ".join(rng.choice(words, rng.integers(8, 30))).title() + " 12 %!", lang)
        for i in range(n)
        for j, (lang, words) in enumerate(STEMS.items())
    ]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(texts(40, 0), "doc_id long, text string, lang string"), most=30)


def test_families_then_languages(model):
    assert model.families == [("germanic", ["de", "en"]), ("romance", ["es", "fr"]), ("uralic", ["fi"])]
    assert model.pairs == [("de", "en"), ("es", "fr")]


def test_unseen_texts(spark, model):
    rows = texts(20, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_predictions_read_the_text_only(spark, model):
    df = spark.createDataFrame(texts(5, 2), "doc_id long, text string, lang string")
    plain = langid.identify(df, model).select("text", "lang_pred", "score").collect()
    moved = langid.identify(df.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("x").alias("lang")), model)
    assert sorted(plain) == sorted(moved.select("text", "lang_pred", "score").collect())


def test_held_out_ids(spark):
    df = spark.createDataFrame([(i,) for i in [*range(-5, 200), None]], "doc_id long")
    for r in df.select("doc_id", langid.held_out().alias("h"), langid.learnable().alias("l")).collect():
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["h"] == want and r["l"] == (r["doc_id"] is not None and not want)


def test_the_sample_is_bounded(spark):
    df = spark.createDataFrame([("en", f"word {i % 700}") for i in range(2000)] + [("de", "Wort")] * 3, "lang string, text string")
    got = {r["lang"]: r["count"] for r in langid._sample(df, 100).groupBy("lang").count().collect()}
    assert got["de"] == 3 and got["en"] <= 100


def test_copies_and_unusable_rows_take_no_place_in_the_sample(spark):
    rows = [("en", f"word {i % 5}") for i in range(4000)] + [("fr", f"mot {i}") for i in range(200)]
    rows += [("fr", t) for t in (None, "12 %", "mot 0") for _ in range(3000)] + [("de", f"Wort {i}") for i in range(30)]
    rows += [("es", None)] * 9 + [(None, "x")] * 9
    sample = langid._sample(spark.createDataFrame(rows, "lang string, text string").repartition(4), 50)
    got = {}
    for r in sample.collect():
        got.setdefault(r["lang"], []).append(r["text"])
    assert {lang: len(t) for lang, t in got.items()} == {"en": 5, "fr": 50, "de": 30}
    assert all(len(set(t)) == len(t) for t in got.values())


def test_parts_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "Straße été " * 400
    whole = np.concatenate(list(langid._grams(text)))
    monkeypatch.setattr(langid, "_PART", 100)
    assert sorted(np.concatenate(list(langid._grams(text)))) == sorted(whole)


def test_odd_rows_and_models(spark, odd, none, model):
    got = langid.identify(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    for r in got.collect():
        blank = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0) == blank
    assert langid.identify(none, model).count() == 0
    untaught = langid.fit(none.select("lang", "text"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, untaught).collect()} == {("und", 0.0)}
    single = langid.fit(spark.createDataFrame([("xx", "abc"), (None, "def"), ("xx", None)], "lang string, text string"))
    assert single.predict("hello") == ("xx", 1.0) and single.predict("12") == ("und", 0.0)


def test_query_accuracy(spark, sf, documents):
    import __spark_entry__ as entry

    got = entry.queries()["op6_family_then_language"](spark, sf).toPandas().merge(documents, on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(documents) and (held.lang == held.lang_pred).mean() > 0.9
