import re

import pytest
import regex
from pyspark.sql import functions as F

from visitloom.llm import surrogates

PLANTED = {
    "email": ["und.34@mail7.example.com", "Und.34@Mail7.Example.com", "oi.78@mail3.example.com", "a@b.co"],
    "card": ["4757965300669737", "4757 9653 0066 9737", "9807915762804490"],
    "ip": ["97.51.17.173", "255.0.0.1"],
    "phone": ["+1 (017) 555-7713", "+1-017-555-7713", "+49 30 1234 5678", "(030) 555-1234"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    "person": ["Mr. John Smith", "Mrs Smith", "Frau ÄNNE MÜLLER", "Господин Иван Петров"],
}
TEXT = "start {} middle, {}. end"


@pytest.fixture(scope="module")
def done(spark):
    values = [(kind, v) for kind, vs in PLANTED.items() for v in vs]
    rows = [(i, TEXT.format(v, values[i - 1][1])) for i, (_, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in surrogates.replaced(df, "k").collect()}
    return values, got


def test_every_entity_is_replaced_in_place(done):
    values, got = done
    for i, (kind, value) in enumerate(values):
        first, second = got[i]["entities"]
        assert got[i]["text"] == TEXT.format(first["surrogate"], second["surrogate"])
        assert first["kind"] == kind and value not in got[i]["text"]


def test_one_entity_has_one_surrogate_and_two_never_share(done):
    values, got = done
    shown = {}
    for i, (kind, value) in enumerate(values):
        assert shown.setdefault(value, got[i]["entities"][0]["surrogate"]) == got[i]["entities"][0]["surrogate"]
        assert got[(i + 1) % len(values)]["entities"][1]["surrogate"] == shown[value]
    digits = lambda v: re.sub(r"\D", "", shown[v])
    assert digits("4757965300669737") == digits("4757 9653 0066 9737") != digits("9807915762804490")
    assert digits("+1 (017) 555-7713") == digits("+1-017-555-7713")
    assert shown["und.34@mail7.example.com"] == shown["Und.34@Mail7.Example.com"] != shown["oi.78@mail3.example.com"]
    assert shown["DE89370400440532013000"] == shown["DE89 3704 0044 0532 0130 00"].replace(" ", "")


def test_surrogates_keep_kind_format_gender_and_script(done):
    values, got = done
    shape = lambda v: re.sub("[0-9]", "0", v)
    for i, (kind, value) in enumerate(values):
        new = got[i]["entities"][0]["surrogate"]
        assert regex.fullmatch(surrogates.PATTERNS[kind], new), (value, new)
        if kind in ("card", "phone", "ssn"):
            assert shape(new) == shape(value)
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(re.sub(r"\D", "", new))))
            assert total % 10 == 0 and new[0] == value[0]
        if kind == "phone" and value.startswith("+"):
            assert new.split()[0].split("-")[0] == value.split()[0].split("-")[0]
        if kind == "email":
            assert re.search(r"\.example\.(com|net|org)$", new)
    names = {v: got[i]["entities"][0]["surrogate"] for i, (k, v) in enumerate(values) if k == "person"}
    title, given, _ = names["Mr. John Smith"].split()
    assert title == "Mr." and given in surrogates.GIVEN["m", "latin"]
    assert names["Mrs Smith"].startswith("Mrs ") and len(names["Mrs Smith"].split()) == 2
    title, given, family = names["Frau ÄNNE MÜLLER"].split()
    assert given.title() in surrogates.GIVEN["f", "latin"] and family == family.upper()
    assert names["Господин Иван Петров"].split()[1] in surrogates.GIVEN["m", "cyrillic"]


def run(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in surrogates.replaced(df, key).collect()}
    return [got[i] for i in range(len(texts))]


def test_mentions_of_one_person(spark):
    text = "Dr Anna Smith met Mrs Anna Smith. Anna Smith, ANNA SMITH and Smith; Mrs. Smith, not smithy or Blacksmith."
    row, other = run(spark, text, "Mrs Anna Smith again")
    given, family = other["text"].split()[1:3]
    assert given in surrogates.GIVEN["f", "latin"]
    assert row["text"] == (
        f"Dr {given} {family} met Mrs {given} {family}. {given} {family}, {given.upper()} {family.upper()} and {family}; "
        f"Mrs. {family}, not smithy or Blacksmith."
    )
    assert [e["surrogate"] for e in row["entities"]] == [
        f"Dr {given} {family}", f"Mrs {given} {family}", f"{given} {family}", f"{given.upper()} {family.upper()}", family, f"Mrs. {family}",
    ]


def test_two_persons_of_a_document_stay_two(spark):
    (row,) = run(spark, "Mr John Smith and Mr Paul Jones: Mr Smith, JOHN SMITH, Jones, Mr. Jones, Mr Brown")
    a, b = row["text"].split(": ")
    _, john, smith, _, _, paul, jones = a.split()
    assert len({john + smith, paul + jones}) == 2 and smith != jones
    assert b.startswith(f"Mr {smith}, {john.upper()} {smith.upper()}, {jones}, Mr. {jones}, Mr ")
    assert b.split()[-1] not in ("Brown", smith, jones)
    assert not re.search("john|smith|paul|jones|brown", row["text"], re.I)


def test_a_name_in_another_document_stays_without_its_person(spark):
    rows = run(spark, "Herr Jörg Weiß und Weiß", "Weiß ist eine Farbe", "Herr Weiß")
    assert rows[1]["text"] == "Weiß ist eine Farbe"
    _, _, weiss, _, again = rows[0]["text"].split()
    assert weiss == again and rows[2]["text"].split()[1] not in ("Weiß", weiss)


def plainly_replaced(text, rows):
    """The text with each entity of ``rows`` (old, new) put in place of the old, by position, in plain Python."""
    out, at = "", 0
    for old, new in rows:
        start = text.index(old, at)
        out, at = out + text[at:start] + new, start + len(old)
    return out + text[at:]


def test_texts_are_what_plain_replacement_makes(spark):
    olds = ["Mr John Smith", "a@b.co", "Smith", "97.51.17.173", "Mr Smith", "JOHN SMITH", "+1 (017) 555-7713", "john smith"]
    text = "".join(f"{i}) {old}, " for i, old in enumerate(olds))
    (row,) = run(spark, text)
    news = [e["surrogate"] for e in row["entities"]]
    assert len(news) == len(olds) and row["text"] == plainly_replaced(text, list(zip(olds, news)))
    assert news[7].lower() == news[5].lower() == news[0].lower().removeprefix("mr ")


def test_a_used_up_form_grows(spark):
    """Six-digit numbers of which nearly all are real: no free one of that form is left for most."""
    rows = spark.range(90_000).selectExpr("'phone' AS kind", "concat('1', lpad(cast(id AS string), 5, '0')) AS entity")
    table = surrogates.surrogate_table(rows.union(spark.range(10_000).selectExpr("'phone'", "cast(id AS string)")), "k")
    assert table.select("surrogate").distinct().count() == 100_000
    assert table.join(rows, table["surrogate"] == rows["entity"], "left_semi").isEmpty()
    (row,) = spark.createDataFrame([("+12 34", "9876543")], "value string, s string").select(
        surrogates.rendered(F.lit("phone"), F.col("value"), F.col("s"), F.lit(False)).alias("out")
    ).collect()
    assert row["out"] == "+98 76543"


def test_the_key_decides(spark, done):
    _, got = done
    df = spark.createDataFrame([(0, got[0]["text"]), (1, "mail a@b.co")], "doc_id long, text string")
    one, two = ({r["doc_id"]: r["text"] for r in surrogates.replaced(df, k).collect()} for k in ("x", "y"))
    assert one[1] != two[1]


def test_collisions_are_drawn_again(spark, monkeypatch):
    # a candidate with few values at first, as many as entities only later
    def poor(kind, entity, draw, key):
        return F.when(draw >= 4, F.concat(F.lit("s"), entity)).otherwise(
            F.concat(F.lit("p"), F.pmod(F.crc32(F.concat(entity, draw.cast("string"))), F.lit(8)).cast("string"))
        )

    monkeypatch.setattr(surrogates, "candidate", poor)
    rows = [("email", f"e{i}") for i in range(40)] + [("email", "p3"), ("email", "P4"), ("ip", "e1")]
    table = surrogates.surrogate_table(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert len(table) == len(rows)
    mail = [r["surrogate"].lower() for r in table if r["kind"] == "email"]
    assert len(set(mail)) == len(mail) and not {"p3", "p4"} & set(mail)


def test_clean_texts_stay(spark):
    texts = ["Version 2.0. of 1.2.3", "an id 04dbebab91ab85687d33eeaaf9ac699e1188f962", "in 2024, 1,000,000 or 12-34", "a @ b", "Dr. no"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in surrogates.replaced(df, "k").collect()} == dict(enumerate(texts))


def test_odd_rows(spark, odd, none):
    got = surrogates.replaced(odd, "k")
    assert got.columns == [c for c in odd.columns if c != "text"] + ["text", "entities"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        ((r["doc_id"], r["text"]) for r in odd.collect()), key=str
    )
    assert surrogates.replaced(none, "k").count() == 0
    rows = [(None, "a@b.co " * 3000), (1, "a@b.co"), (1, "a@b.co"), (2, None)]
    got = surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert sorted(len(r["entities"]) for r in got) == [0, 1, 1, 3000]
    assert len({e["surrogate"] for r in got for e in r["entities"]}) == 1


def test_query(spark, sf, documents):
    import __spark_entry__ as entry

    got = entry.queries()["op9_surrogates"](spark, sf).toPandas().set_index("doc_id")
    patterns = [r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", r"\+1 \(\d+\) \d{3}-\d{4}", r"\d+\.\d+\.\d+\.\d+", r"(?<!\w)\d{16}(?!\w)"]
    new = {}
    for doc_id, text in zip(documents.doc_id, documents.text):
        for pattern in patterns:
            before, after = re.findall(pattern, text), re.findall(pattern, got.loc[doc_id].text)
            assert len(before) == len(after) and not [x for x in before if x in got.loc[doc_id].text]
            assert all(new.setdefault(x, y) == y for x, y in zip(before, after))
        if not got.loc[doc_id].n_entities:
            assert got.loc[doc_id].text == text
    assert len(set(new.values())) == len(new)
