import hashlib
import math
import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from visitloom.llm import randomness

ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


TEXTS = [
    "", None, "nothing", 'é👍🏽 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "API_KEY:abcdefghijkl apikey=short",
    'token: "password" : "abcdefghijklmnop"', "secret=secret=abcdefghijkl", "AKIAABCDEFGHIJKLMN AKIAAKIAAKIA AKIASHORT",
    "AKIAAKIA" + "Z" * 20, "deadbeefdeadbee deadbeefdeadbeef0 DEADBEEFDEADBEEF00", "passwd  =  'x.y/z+w-v_u=t'",
    "token=" + "0123456789abcdef" * 500, " ".join(f"{i:016x}" for i in range(900)), "ſecret=abcdefghijkl toKen=abcdefghijkl",
]


def test_patterns_and_places(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in randomness.secrets(df).collect():
        got = [tuple(s) for s in r["found"] if s["kind"] < 3]
        assert got == base(TEXTS[r["doc_id"]] or ""), TEXTS[r["doc_id"]]
    listed = randomness.secrets(df).select("doc_id", randomness.listed(F.col("found")).alias("s")).collect()
    names = ("assign", "access", "hex", "random")
    found = {r["doc_id"]: r["found"] for r in randomness.secrets(df).collect()}
    assert {r["doc_id"]: r["s"] for r in listed} == {
        i: ",".join(f"{names[s['kind']]}:{s['start']}:{s['end']}" for s in v) for i, v in found.items()
    }


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_total(spark, n):
    values = [random.Random(i).randint(0, 99) for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(randomness.running_total(F.col("v"))).first()[0] == list(accumulate(values))


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def chi_tail(chi, df):
    return tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def p_value(value):
    v = value.rstrip("=")
    name, alphabet = next((e, a) for e, a in randomness.ENCODINGS if set(v) <= set(a))
    x, n, k = [alphabet.index(c) for c in v], len(v), len(alphabet)
    p_chi = chi_tail(k / n * sum(v.count(c) ** 2 for c in set(v)) - n, k - 1)
    kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" for c in v]
    alphabet_kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" for c in alphabet]
    q = {c: alphabet_kinds.count(c) / k for c in set(alphabet_kinds)}
    least = [p_chi]
    if len(q) > 1:
        least.append(chi_tail(sum(kinds.count(c) ** 2 / (n * q[c]) for c in q) - n, len(q) - 1))
        stays, same, thrice = sum(a == b for a, b in zip(kinds, kinds[1:])), sum(x**2 for x in q.values()), sum(x**3 for x in q.values())
        variance = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same * same)
        least.append(2 * tail(abs(stays - (n - 1) * same) / math.sqrt(variance)))
    high = [a >= k / 2 for a in x]
    n1 = sum(high)
    mean = 2 * n1 * (n - n1) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    p_runs = 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0
    scatter = n * sum(a * a for a in x) - sum(x) ** 2
    lag = n * sum(a * b for a, b in zip(x, x[1:] + x[:1])) - sum(x) ** 2
    sigma = math.sqrt(n * (n - 3) / (n + 1)) / (n - 1)
    p_serial = 2 * tail(abs(lag / scatter + 1 / (n - 1)) / sigma) if scatter else 0
    least += [p_runs, p_serial]
    return name, 1 - (1 - min(1, *least)) ** len(least)


def tokens(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(randomness.ENCODINGS)[1]) for _ in range(rng.randint(20, 60))) for _ in range(n)]


def test_battery(spark):
    words = ["internationalisation", "a" * 30, "ab" * 15, "0123456789" * 3, "the-quick-brown-fox-jumps-over"]
    values = [t for t in tokens(1) + words if len(t) >= 20]
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, value string").select(
        "i", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), "value")).alias("t")
    )
    for r in df.select("i", randomness.tested(F.col("t"))[0].alias("t")).collect():
        name, p = p_value(values[r["i"]])
        assert r["t"]["encoding"] == name and r["t"]["p"] == pytest.approx(p, abs=2e-6)


WORDS = (
    "time year people way day man thing woman life child world school state family student group country problem hand part "
    "place case week company system program question work government number night point home water room mother area money "
    "story fact month lot right study book eye job word business issue side kind head house service friend father power hour "
    "game line end member law car city community name president team minute idea kid body information back parent face level"
).split()
LETTERS = randomness._UPPER + randomness._LOWER + randomness._DIGITS
ALPHABETS = {
    "HEX": randomness._DIGITS + "ABCDEF", "base32": randomness._UPPER + "234567", "alnum": LETTERS,
    "base64": LETTERS + "+/", "base64url": LETTERS + "-_",
}
LENGTHS = (20, 24, 32, 40, 64)


def joined_words(rng):
    """Words as paths, identifiers, constants, camel case, hyphenated or run together, some with a number."""
    many = [rng.choice(WORDS) for _ in range(rng.randint(4, 9))]
    style = rng.choice(["/", "_", "-", "", "Camel", "CONST", "Path/"])
    if style == "Camel":
        return "".join(w.title() for w in many) + rng.choice(["", str(rng.randint(1, 999))])
    if style == "CONST":
        return "_".join(many).upper() + rng.choice(["", f"_{rng.randint(1, 99)}"])
    if style == "Path/":
        return "/".join(w.title() for w in many)
    return style.join(many) + rng.choice(["", f"{style}{rng.randint(1, 999)}"])


def test_recall_by_encoding_and_length(spark):
    rng = random.Random(11)
    planted = [(e, n, "".join(rng.choice(a) for _ in range(n))) for e, a in ALPHABETS.items() for n in LENGTHS for _ in range(60)]
    words = [("words", 0, w) for w in (joined_words(rng) for _ in range(2500)) if len(w) >= 20][:1500]
    rows = [(i, e, n, f"see {t} there") for i, (e, n, t) in enumerate(planted + words)]
    df = spark.createDataFrame(rows, "doc_id long, e string, n int, text string")
    got = randomness.secrets(df).groupBy("e", "n").agg(F.count("*").alias("rows"), F.count_if(F.size("found") > 0).alias("found"))
    cells = {(r["e"], r["n"]): (r["found"], r["rows"]) for r in got.collect()}
    false = cells.pop(("words", 0))
    shares = {key: f / n for key, (f, n) in cells.items()}
    print(shares, false)
    assert min(shares.values()) >= 0.9, {k: v for k, v in shares.items() if v < 0.9}
    assert false[0] <= 0.1 * (false[0] + sum(f for f, _ in cells.values()))


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    alphabet = randomness.ENCODINGS[5][1]
    keys = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(60)]
    words = ["".join(rng.choice(["tion", "the", "en", "er", "ing", "at", "on"]) for _ in range(14)) for _ in range(200)]
    rows = [(i, f"x {k} y") for i, k in enumerate(keys)] + [(100 + i, f"x {w} y") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in randomness.secrets(df).collect() if r["found"]}
    assert len([i for i in found if i < 100]) >= 50 and not [i for i in found if i >= 100]


def test_thresholds_go_by_length(spark):
    rows = [("hex", 32, p / 100) for p in range(100)] + [("hex", 32, 0.001)] * 300
    rows += [("hex", 64, 0.001)] * 50 + [("hex", 20, 0.3)] * 40 + [("hex", 20, 0.9)] * 2
    df = spark.createDataFrame(rows, "encoding string, n int, p double")
    got = randomness.thresholds(df, 0.1)
    assert set(got) == {("hex", 10), ("hex", 8)}
    assert got["hex", 10] == 0.05 and got["hex", 8] == 0.35


def hex_keys(wanted, n=32):
    """For each pair of bounds a key of ``n`` upper-case hex digits whose p is between them."""
    rng, out = random.Random(5), []
    for low, high in wanted:
        while True:
            key = "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
            if p_value(key)[0] == "HEX" and low <= p_value(key)[1] < high:
                out.append(key)
                break
    return out


@pytest.mark.parametrize("copied", [(0.3, 0.32), (0.9, 0.95)])
def test_copies_of_a_token_count_once(spark, copied):
    keys = hex_keys([(i / 60, (i + 1) / 60) for i in range(3, 60)])
    copy = hex_keys([copied], 33)[0]
    words = [w * 4 for w in hex_keys([(0, 1)] * 40, 8) if p_value(w * 4)[0] == "HEX"]
    rows = [(i, f"x {k} y") for i, k in enumerate(keys)] + [(1000, f"{copy} {copy} y")] * 1000
    rows += [(2000 + i, f"x {w} y") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r["doc_id"] for r in randomness.secrets(df).collect() if r["found"]]
    once = df.dropDuplicates(["doc_id"])
    alone = {r["doc_id"] for r in randomness.secrets(once).collect() if r["found"]}
    assert set(found) == alone and found.count(1000) == 1000
    assert len([i for i in alone if i < 1000]) >= 50


def test_a_lone_token_of_a_rare_class_is_found(spark):
    lone = hex_keys([(0.2, 0.3)], 32)[0]
    rows = [(1, f"x {lone} y"), (2, "x " + "AB01" * 16 + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in randomness.secrets(df).collect() if r["found"]] == [1]


def test_small_classes_share_what_they_tell(spark):
    rows = [("hex", n, p) for n in (20, 24, 32) for p in [0.2] * 8 + [0.9]]
    rows += [("alnum", 20, 0.3)] * 3
    df = spark.createDataFrame(rows, "encoding string, n int, p double")
    got = randomness.thresholds(df, 0.1)
    assert got == {("hex", 8): 0.25, ("hex", 9): 0.25, ("hex", 10): 0.25, ("alnum", 8): 0.05}


def test_odd_rows(odd, none):
    got = randomness.secrets(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert {r["doc_id"] for r in got.collect() if r["found"]} == set()
    assert randomness.secrets(none).count() == 0


def test_query(spark, sf, documents):
    import __spark_entry__ as entry

    got = entry.queries()["op5_randomness_tests"](spark, sf).toPandas().set_index("doc_id")
    for doc_id, text in zip(documents.doc_id, documents.text):
        spans = base(text)
        joined = ",".join(f"{randomness.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got.loc[doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
