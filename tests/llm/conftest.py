import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, id string, size string, kept string, at long, fp string, found string"
)


def padded(*rows):
    """Rows (doc_id, text, lang, source) with values in columns that clash with helpers."""
    return [(*r, None if r[1] is None else len(r[1]), "r", "i", "s", "k", 7, "f", None) for r in rows]


ODD = padded(
    (1, "plain words in a row", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", None, "b"),
    (None, "no id here but some words", "en", None),
    (None, None, None, None),
    (5, "plain words in a row", "en", "a"),
    (5, "plain words in a row", "en", "a"),
    (6, "straße ÉÉ 日本語 👍🏽\x0bx\x85y", "de", "b"),
    (7, "long " + " ".join(f"w{i}" for i in range(30000)), "en", "c"),
    (8, "x" * 50000, "en", "c"),
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    return spark.createDataFrame(ODD, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(sf):
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet")
