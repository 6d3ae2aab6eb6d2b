"""Personal data replaced by keyed surrogates.

Entities are found by pattern, in one pass for all kinds. Each distinct entity of
the whole table gets a surrogate that a keyed digest draws: the same kind, in a
form that fits each occurrence (its punctuation, case, title and script, a given
name of the same gender). One entity has one surrogate wherever and however it is
written, and two entities never share one: candidates that meet each other, one
given before or a real entity of the table are drawn again.

A person is a name, whatever the title; the gender is what most titles of the name
say. Within a document a titled family name alone is the person of that family name
who is named in full there and not with a title of the other gender, and where a person is found, the name in full, in any
case, and the capitalised family name are replaced without a title too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import packed, unpacked
from visitloom.session import materialize

# Titles by the gender they tell, "" if none. With or without a full stop.
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Госпожа"),
    "": ("Dr", "Prof"),
}
# Given names that surrogates draw from, by gender and script.
GIVEN = {
    ("m", "latin"): ("Aldo", "Bruno", "Cedric", "Dario", "Edgar", "Felix", "Gustav", "Hugo", "Ivo", "Jasper", "Konrad", "Leon", "Milo", "Nestor", "Oskar", "Pablo"),
    ("f", "latin"): ("Agnes", "Berta", "Clara", "Daria", "Elsa", "Flora", "Greta", "Hilda", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"),
    ("", "latin"): ("Alex", "Charlie", "Dana", "Eli", "Jamie", "Kim", "Lou", "Maxime", "Noa", "Quinn", "Robin", "Sacha", "Sam", "Toni", "Vanja", "Yael"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Олег", "Павел", "Роман", "Семён", "Тарас", "Юрий"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Ева", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Тамара", "Юлия"),
    ("", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоша", "Мика", "Рени", "Лео", "Ники", "Дани", "Гера", "Вита", "Тони", "Сима"),
}
# Syllables of surrogate family names, by script.
SYLLABLES = {
    "latin": ("ba", "del", "fi", "gor", "ha", "jen", "ka", "lum", "mi", "nor", "pe", "ras", "so", "tal", "vi", "zen"),
    "cyrillic": ("ба", "дел", "фи", "гор", "ха", "жен", "ка", "лум", "ми", "нор", "пе", "рас", "со", "тал", "ви", "зен"),
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_CAPITAL = r"\p{Lu}[\p{L}'’-]{1,40}"

# Patterns of the kinds; at one place the first that fits wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "phone": (
        r"(?<![A-Za-z0-9])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
        r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![A-Za-z0-9])"
    ),
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE_PART = rf"^((?:{_TITLE})\.?) "
# From this draw on a surrogate grows, so that even a used-up form finds a free one.
GROW_AFTER = 6


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        # a value was cut out of its text, so what stood around it is gone
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def identity(kind: Column, value: Column) -> Column:
    """What makes two occurrences the same entity: case, punctuation and title don't count."""
    compact = F.upper(F.regexp_replace(value, r"[ .-]", ""))
    name = F.lower(F.regexp_replace(value, _TITLE_PART, ""))
    return (
        F.when(kind.isin("card", "ssn", "phone"), _digits(value))
        .when(kind == "iban", compact)
        .when(kind == "person", name)
        .otherwise(F.lower(value))
    )


def _gender(value: Column) -> Column:
    title = F.regexp_replace(F.regexp_extract(value, _TITLE_PART, 1), r"\.$", "")
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("")


def _digest(key: str, *parts: Column) -> Column:
    """Keyed digest, 64 hex digits."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _hex(digest: Column, at, n: int) -> Column:
    return F.conv(F.substring(digest, F.lit(at) if isinstance(at, int) else at, F.lit(n)), 16, 10).cast("int")


def _redrawn(text: Column, digest: Column) -> Column:
    """``text`` with each ASCII letter and digit drawn anew, of its own class; the rest stays."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    wide = F.concat(digest, F.sha2(digest, 256), F.sha2(F.reverse(digest), 256))

    def draw(c: Column, i: Column) -> Column:
        value = _hex(wide, F.pmod(i * 2, F.lit(190)).cast("int") + 1, 2)
        pick = lambda chars: F.substring(F.lit(chars), value % len(chars) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike("[a-z]"), pick(letters))
            .when(c.rlike("[A-Z]"), pick(letters.upper()))
            .otherwise(c)
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, draw), "")


def _check_digit(body: Column) -> Column:
    """Luhn digit that closes a card number's ``body``."""
    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")

    def value(c, i):
        doubled = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def candidate(kind: Column, entity: Column, draw: Column, key: str) -> Column:
    """The surrogate identity of an entity at its ``draw``-th draw.

    A person comes as ``gender:name``. From ``GROW_AFTER`` on digits are added, if need
    be beyond the form, so that there is always a free one.
    """
    digest = _digest(key, kind, entity, draw)
    longer = draw >= GROW_AFTER
    extra = F.when(longer, F.translate(F.substring(digest, 41, 6), "abcdef", "012345")).otherwise("")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    own = _digest(key, F.lit("domain"), domain)
    place = F.element_at(F.lit(["com", "net", "org"]), _hex(own, 9, 2) % 3 + 1)
    label = F.translate(F.substring(own, 11, 8), "0123456789", "ghijklmnop")
    email = F.concat(_redrawn(local, digest), extra, F.lit("@"), label, F.lit(".example."), place)

    n = F.length(entity)
    drawn = F.translate(F.concat(digest, F.sha2(digest, 256)), "abcdef", "012345")
    body = F.concat(F.substring(entity, 1, 1), F.substring(drawn, F.lit(1), n - 2), extra)
    card = F.concat(body, _check_digit(body))
    iban = F.concat(F.substring(entity, 1, 2), _redrawn(F.substring(entity, F.lit(3), n), digest))
    octets = [(_hex(digest, 1 + 2 * i, 2) % 254 + 1).cast("string") for i in range(4)]
    # the country's digits, which stand before the last ten, stay
    country = F.greatest(n - 10, F.lit(0))
    phone = F.concat(F.substring(entity, F.lit(1), country), F.substring(drawn, F.lit(1), n - country))

    gender, name = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = F.size(F.split(name, " "))
    names = F.create_map(*[x for (g, s), v in GIVEN.items() for x in (F.lit(f"{g}:{s}"), F.lit(list(v)))])
    syllables = F.create_map(*[x for s, v in SYLLABLES.items() for x in (F.lit(s), F.lit(list(v)))])
    given = F.element_at(F.element_at(names, F.concat(gender, F.lit(":"), script)), _hex(digest, 1, 1) + 1)
    parts = F.transform(
        F.sequence(F.lit(2), F.when(longer, 10).otherwise(6)),
        lambda i: F.element_at(F.element_at(syllables, script), _hex(digest, i, 1) + 1),
    )
    family = F.initcap(F.array_join(parts, ""))
    person = F.concat(
        gender, F.lit(":"), F.when(words > 1, F.concat(given, F.lit(" "), family)).otherwise(family)
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(iban, extra))
        .when(kind == "ip", F.concat(F.concat_ws(".", *octets), extra))
        .when(kind == "ssn", F.concat(F.substring(drawn, F.lit(1), n), extra))
        .when(kind == "phone", F.concat(phone, extra))
        .otherwise(person)
    )


def _cased(name: Column, like: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(name)).otherwise(name)


def rendered(kind: Column, value: Column, surrogate: Column, short: Column) -> Column:
    """A surrogate identity in the form of one occurrence; ``short``: the family name only."""
    first = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def filled(of: str, taken: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")

        def put(acc, c):
            hit = c.rlike(of)
            return F.struct(
                F.when(hit, acc["at"] + 1).otherwise(acc["at"]).alias("at"),
                F.concat(acc["out"], F.when(hit, F.substring(taken, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            )

        # what a grown surrogate has more than the occurrence follows it
        return F.aggregate(
            chars, first, put, lambda acc: F.concat(acc["out"], F.substring(taken, acc["at"], F.length(taken)))
        )

    title = F.regexp_extract(value, _TITLE_PART, 1)
    name = F.substring_index(surrogate, ":", -1)
    name = F.when(short, F.substring_index(name, " ", -1)).otherwise(name)
    cased = _cased(name, F.regexp_replace(value, _TITLE_PART, ""))
    return (
        F.when(kind.isin("card", "ssn", "phone"), filled("[0-9]", surrogate))
        .when(kind == "iban", filled("[A-Z0-9]", surrogate))
        .when(kind == "person", F.concat_ws(" ", title, cased))
        .when((value == F.upper(value)) & (kind == "email"), F.upper(surrogate))
        .otherwise(surrogate)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): distinct, and no entity of the table.

    The first of equal candidates by entity keeps it, the others draw again.
    """
    entities = materialize(entities.select("kind", "entity").distinct(), "entities")
    # compared without case
    taken = entities.select("kind", F.lower("entity").alias("form"))
    given, pending, draw = None, entities, 0
    while True:
        # a longer form is drawn in the end, so this ends
        drawn = pending.withColumn(
            "surrogate", candidate(F.col("kind"), F.col("entity"), F.lit(draw), key)
        )
        first = Window.partitionBy("kind", "form").orderBy("entity")
        drawn = (
            drawn.withColumn("form", F.lower("surrogate"))
            .withColumn("place", F.row_number().over(first))
            .join(taken.withColumn("used", F.lit(True)), ["kind", "form"], "left")
            .select("kind", "entity", "surrogate", (F.col("used").isNull() & (F.col("place") == 1)).alias("free"))
        )
        drawn = materialize(drawn, "drawn")
        done = drawn.where("free").select("kind", "entity", "surrogate")
        given = done if given is None else given.union(done)
        taken = taken.union(done.select("kind", F.lower("surrogate")))
        pending, draw = drawn.where("NOT free").select("kind", "entity"), draw + 1
        if pending.isEmpty():
            return given


def _persons(each: DataFrame) -> DataFrame:
    """``entity`` of persons as ``gender:name``, and ``short`` for a family name that stands for a full one.

    A titled family name is the first person of its document with that family name whose
    title tells no other gender.
    """
    columns = ["at", "i", "value", "kind", "entity", "short"]
    others = each.where("kind != 'person'").withColumn("short", F.lit(False)).select(*columns)
    each = each.where("kind = 'person'").withColumn("told", _gender(F.col("value")))
    in_full = F.col("entity").contains(" ")
    whole = F.when(in_full, F.struct("i", F.col("entity").alias("name"), "told"))
    there = F.array_sort(F.collect_list(whole).over(Window.partitionBy("at")))  # of one document
    same = F.filter("_there", lambda p: (F.substring_index(p["name"], " ", -1) == F.col("entity")) & (
        (p["told"] == "") | (F.col("told") == "") | (p["told"] == F.col("told"))
    ))
    each = each.withColumn("_there", there).withColumn("_full", F.when(~in_full, F.get(same, F.lit(0))["name"]))
    each = each.withColumn("short", F.col("_full").isNotNull()).withColumn("entity", F.coalesce("_full", "entity"))
    votes = each.groupBy(F.col("entity").alias("name")).agg(
        F.count_if(F.col("told") == "m").alias("m"), F.count_if(F.col("told") == "f").alias("f")
    )
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("")
    voted = each.join(votes, F.col("entity") == F.col("name"))
    return others.union(voted.withColumn("entity", F.concat(gender, F.lit(":"), "entity")).select(*columns))


def _further_mentions(dirty: DataFrame) -> DataFrame:
    """Text and entities of documents with persons: their names are replaced without a title too."""
    last = lambda c: F.substring_index(c, " ", -1)
    # a person's name in full in any case, the family name with a capital or in capitals
    full = F.transform(F.filter("names", lambda n: n["name"].contains(" ")), lambda n: n)
    order = lambda a, b: F.length(b["name"]) - F.length(a["name"])
    full = F.array_sort(full, lambda a, b: F.when(order(a, b) != 0, order(a, b)).otherwise(F.when(a["name"] < b["name"], -1).otherwise(1)))
    whole = F.transform("_full", lambda n: F.concat(F.lit("(?iu:"), n["name"], F.lit(")")))
    family = F.flatten(F.transform("names", lambda n: F.array(F.initcap(last(n["name"])), F.upper(last(n["name"])))))
    pattern = F.concat(
        F.lit(r"(?<![\p{L}'’-])(?:"), F.array_join(F.concat(whole, F.array_distinct(family)), "|"), F.lit(r")(?![\p{L}’-])")
    )
    dirty = dirty.withColumn("_full", full).withColumn("_pattern", pattern)

    def shown(value: Column) -> Column:
        person = F.get(F.filter("names", lambda n: n["name"] == F.lower(value)), F.lit(0))
        of_family = F.filter("names", lambda n: last(n["name"]) == F.lower(value))
        relative = F.get(F.array_sort(of_family), F.lit(0))
        return _cased(F.coalesce(person["shown"], last(relative["shown"])), value)

    # the pieces between the entities, each with the names in it
    cut = F.transform("between", lambda b: F.struct(
        F.split(b, F.col("_pattern"), -1).alias("rest"),
        F.transform(F.regexp_extract_all(b, F.col("_pattern"), F.lit(0)), shown).alias("put"),
    ))
    dirty = dirty.withColumn("cut", cut)
    joined = F.transform("cut", lambda c: F.array_join(
        F.zip_with(c["rest"], c["put"], lambda r, p: F.concat(r, F.coalesce(p, F.lit("")))), ""
    ))
    named = F.transform("cut", lambda c: F.transform(c["put"], lambda p: F.struct(F.lit("person").alias("kind"), p.alias("surrogate"))))
    entity = lambda p: F.struct(p["kind"].alias("kind"), p["surrogate"].alias("surrogate"))
    return dirty.withColumn("joined", joined).withColumn("named", named).select(
        "row",
        F.array_join(F.zip_with("joined", "put", lambda b, p: F.concat(b, F.coalesce(p["surrogate"], F.lit("")))), "").alias("text"),
        F.flatten(F.zip_with("named", "put", lambda n, p: F.when(p.isNull(), n).otherwise(F.concat(n, F.array(entity(p)))))).alias("entities"),
    )


def replaced(
    docs: DataFrame, key: str, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Each row with its text replaced and ``entities``, an array of ``kind`` and ``surrogate`` in order.

    ``key`` is secret: with it the same table gives the same surrogates, without
    it they can't be traced back. Defined cases: a null text stays null and an
    empty one empty, both without entities. Ids are not used, so null and
    repeated ids and rows stay as they are. An empty table gives an empty table.
    ``carry`` names the input columns to return besides the text, all if not
    given; a column named ``entities`` is replaced.
    """
    carry = docs.columns if carry is None else carry
    text = F.col(text_col)
    rows = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry]), text_col).alias("row"), text.alias("text")
    )
    kind = "array<struct<kind:string,surrogate:string>>"
    # one scan for all rows; the row number is written with the row, so that all readers see the same
    stored = materialize(
        rows.select(
            "row", "text", F.monotonically_increasing_id().alias("at"),
            F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("values"),
        ),
        "scanned",
    )
    hit = F.coalesce(F.size("values") > 0, F.lit(False))
    clean = stored.where(~hit).select("row", "text", F.array().cast(kind).alias("entities"))
    found = stored.where(hit).withColumn("between", F.split("text", ANY, -1))
    each = found.select("at", F.posexplode("values").alias("i", "value"))
    each = each.withColumn("kind", kind_of(F.col("value")))
    each = materialize(_persons(each.withColumn("entity", identity(F.col("kind"), F.col("value")))), "found")
    table = surrogate_table(each.select("kind", "entity"), key)
    shown = rendered(F.col("kind"), F.col("value"), F.col("surrogate"), F.col("short"))
    name = F.when(F.col("kind") == "person", F.struct(
        F.substring_index("entity", ":", -1).alias("name"), F.substring_index("surrogate", ":", -1).alias("shown")
    ))
    own = (
        each.join(table, ["kind", "entity"])
        .select("at", F.struct("i", "kind", shown.alias("surrogate")).alias("put"), name.alias("name"))
        .groupBy("at")
        .agg(F.array_sort(F.collect_list("put")).alias("put"), F.collect_set("name").alias("names"))
    )
    dirty = found.join(own, "at").select("row", "between", "put", "names")
    named = F.size("names") > 0
    plain = dirty.where(~named).select(
        "row", F.array_join(F.zip_with("between", "put", lambda b, p: F.concat(b, F.coalesce(p["surrogate"], F.lit("")))), "").alias("text"),
        F.transform("put", lambda p: F.struct(p["kind"].alias("kind"), p["surrogate"].alias("surrogate"))).alias("entities"),
    )
    out_rows = clean.union(plain).union(_further_mentions(dirty.where(named)))
    out = [c for c in carry if c.lower() not in (text_col.lower(), "entities")]
    return unpacked(out_rows, out, {text_col: F.col("text"), "entities": F.col("entities")})
