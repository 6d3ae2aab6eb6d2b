"""Secret scan: patterns, and a battery of randomness tests for what no pattern names.

A token is a candidate if it is long enough. Its encoding is the smallest known
alphabet that holds it. Under the hypothesis that its symbols are drawn evenly
and independently from that alphabet, five tests give p-values: chi-squared for
uniformity over the symbols and over their classes (capitals, small letters, the
rest), runs above and below the middle and runs of one class, and serial
correlation. The least of them, corrected for their number, is the token's p. An
alphabet of one class has three tests. Words fail that, keys don't: a short token
has too few of each symbol to tell, but enough of each class.

The threshold on p controls false discoveries, by encoding and length. Random
tokens have evenly spread p, so twice the number above one half estimates how many
are random in all; among those accepted at a threshold, what this doesn't explain
is false. Each class takes the lowest threshold at which the false share stays
within ``rate``, give or take the standard error of that estimate: without it a
class of sixty keys and no words would lose a part of them one time in five. A
length at which words pass by chance finds no such threshold.
Each distinct token counts once, however often it is copied. Classes with too few
of them to tell are pooled by encoding; where that is too few as well, the
threshold is a fixed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import packed, unpacked
from visitloom.session import materialize

# Kinds in the order in which they are listed, with their patterns
# (a match is as long as it can be) and the fewest characters that count.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# a run shorter than the least length can't match in part, so the bound is in the pattern
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18

LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}={{0,2}}"

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
# Encodings from the smallest alphabet on; the first that holds a token is its own.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("alnum", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("any", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
# Shares of the character classes in each alphabet: capitals, small letters, the rest.
SHARES = tuple(
    (
        sum(c in _UPPER for c in alphabet) / len(alphabet),
        sum(c in _LOWER for c in alphabet) / len(alphabet),
        sum(c not in _UPPER + _LOWER for c in alphabet) / len(alphabet),
    )
    for _, alphabet in ENCODINGS
)
_CLASSES = (_UPPER + _LOWER, "A" * len(_UPPER) + "a" * len(_LOWER))  # the rest is what is neither
BINS = 20
# Distinct tokens from which on their p tell a threshold, and the threshold for fewer.
LEAST_COUNTED = 20
PRIOR = 0.05  # 0 to 5 of 100 joined words of the test documents reach it, by the way of joining
_RUN = 256  # entries whose running sum is built by appending


def running_total(values: Column) -> Column:
    """Running sums of an array, in time linear in its length for any usual length."""
    longs = "array<bigint>"
    last = F.greatest(F.ceil(F.size(values) / F.lit(_RUN)) - 1, F.lit(0)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _RUN + 1, _RUN))
    zero = F.lit(0).cast("long")

    def step(after: bool):
        def add(acc, x):
            to = acc["at"] + x
            return F.struct(to.alias("at"), F.concat(acc["out"], F.array(to if after else acc["at"])).alias("out"))

        return add

    def cumulated(xs: Column, start: Column, after: bool) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(longs).alias("out"))
        return F.aggregate(xs, first, step(after), lambda acc: acc["out"])

    # a run with its sum, so that no array is built twice
    summed = F.transform(runs, lambda r: F.struct(r.alias("r"), F.aggregate(r, zero, lambda a, x: a + x).alias("s")))
    starts = F.aggregate(
        summed,
        F.struct(zero.alias("at"), F.array().cast("array<struct<r:array<bigint>,o:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["s"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["r"].alias("r"), acc["at"].alias("o")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(starts, lambda x: cumulated(x["r"], x["o"], True)))


def located(frame: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Adds for each pattern an array of ``start``, ``end`` (code points) and ``value``.

    Matches are the leftmost that don't overlap. What lies between them is the
    text split by the same pattern, so their places are running sums of lengths.
    """
    t, names = F.col(text), list(patterns)
    empty = F.array().cast("array<string>")
    columns = frame.columns

    def only_if(pattern: str, value: Column) -> Column:
        return F.when(t.rlike(pattern), value).otherwise(empty)

    frame = frame.select(
        *columns,
        *[only_if(p, F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"_in_{n}") for n, p in patterns.items()],
        *[only_if(p, F.split(t, p, -1)).alias(f"_out_{n}") for n, p in patterns.items()],
    )
    steps = {
        n: F.transform(
            F.arrays_zip(F.slice(f"_out_{n}", 1, F.size(f"_in_{n}")).alias("o"), F.col(f"_in_{n}").alias("i")),
            lambda z: (F.length(z["o"]) + F.length(z["i"])).cast("long"),
        )
        for n in names
    }
    frame = frame.select(*columns, *[f"_in_{n}" for n in names], *[s.alias(f"_step_{n}") for n, s in steps.items()])
    frame = frame.select(
        *columns, *[f"_in_{n}" for n in names], *[running_total(F.col(f"_step_{n}")).alias(f"_end_{n}") for n in names]
    )
    return frame.select(
        *columns,
        *[
            F.zip_with(
                f"_in_{n}",
                f"_end_{n}",
                lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")),
            ).alias(n)
            for n in names
        ],
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, for z >= 0."""
    # The usual polynomial for the normal tail, right to 7 digits.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly


def tested(tokens: Column) -> Column:
    """Array of ``start``, ``end``, ``encoding``, ``token`` (digest), ``n`` and ``p`` for an array of located tokens."""
    names = F.lit([name for name, _ in ENCODINGS])
    sets = F.lit([alphabet for _, alphabet in ENCODINGS])
    shares = [F.lit([q[i] for q in SHARES]) for i in range(3)]

    def inferred(c):
        v = F.rtrim(c["value"], F.lit("="))
        which = F.lit(len(ENCODINGS))
        for i in range(len(ENCODINGS) - 1, 0, -1):
            held = F.translate(v, ENCODINGS[i - 1][1], "") == ""
            which = F.when(held, F.lit(i)).otherwise(which)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), v.alias("v"), which.alias("which"))

    def counted(c):
        symbols = F.filter(F.split(c["v"], ""), lambda s: s != "")
        alphabet = F.element_at(sets, c["which"])
        squares = F.aggregate(
            F.array_distinct(symbols),
            F.lit(0.0),
            lambda a, s: a + F.pow(F.length(c["v"]) - F.length(F.replace(c["v"], s, F.lit(""))), F.lit(2)),
        )
        kinds = F.translate(c["v"], *_CLASSES)
        held = [F.length(kinds) - F.length(F.replace(kinds, F.lit(x), F.lit(""))) for x in "Aa"]
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.element_at(names, c["which"]).alias("encoding"),
            *[F.element_at(q, c["which"]).alias(f"q{i}") for i, q in enumerate(shares)],
            *[h.cast("double").alias(f"c{i}") for i, h in enumerate(held)],
            # 1 a capital, 2 a small letter, 0 the rest
            F.transform(symbols, lambda s: F.instr(F.lit("Aa"), F.translate(s, *_CLASSES))).alias("kind"),
            F.xxhash64(c["v"]).alias("token"),
            F.length(alphabet).cast("double").alias("k"),
            F.length(c["v"]).cast("double").alias("n"),
            F.transform(symbols, lambda s: (F.instr(alphabet, s) - 1).cast("double")).alias("x"),
            squares.alias("squares"),
        )

    def summed(c):
        x, n = c["x"], F.size(c["x"])
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, y: a + y)
        high = lambda y: (y >= c["k"] / 2).cast("double")
        after = F.concat(F.slice(x, 2, n - 1), F.slice(x, 1, 1))
        changes = F.zip_with(F.slice(x, 1, n - 1), F.slice(x, 2, n - 1), lambda a, b: F.abs(high(a) - high(b)))
        kind = c["kind"]
        stays = F.zip_with(F.slice(kind, 1, n - 1), F.slice(kind, 2, n - 1), lambda a, b: (a == b).cast("double"))
        return F.struct(
            *[c[f].alias(f) for f in (*kept, "k", "squares", "q0", "q1", "q2", "c0", "c1")],
            total(stays).alias("stays"),
            total(x).alias("s1"),
            total(F.transform(x, lambda a: a * a)).alias("s2"),
            total(F.zip_with(x, after, lambda a, b: a * b)).alias("s11"),
            total(F.transform(x, high)).alias("n_high"),
            (total(changes) + 1).alias("runs"),
        )

    def chi_tail(chi, df):
        # cube-root approximation of the chi-squared tail
        cube = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        return F.when(cube >= 0, _tail(cube)).otherwise(1 - _tail(-cube))

    def scored(c):
        n, k = c["n"], c["k"]
        p_chi = chi_tail(c["squares"] * k / n - n, k - 1)
        shares = [c["q0"], c["q1"], c["q2"]]
        held = [c["c0"], c["c1"], n - c["c0"] - c["c1"]]
        present = sum((q > 0).cast("double") for q in shares)
        chi_classes = sum(F.when(q > 0, h * h / (n * q)).otherwise(0.0) for q, h in zip(shares, held)) - n
        p_classes = F.when(present > 1, chi_tail(chi_classes, F.greatest(present - 1, F.lit(1.0))))
        same, thrice = sum(q * q for q in shares), sum(q * q * q for q in shares)
        variance = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same * same)
        p_stays = F.when(present > 1, 2 * _tail(F.abs(c["stays"] - (n - 1) * same) / F.sqrt(variance)))
        low = n - c["n_high"]
        mean = 2 * c["n_high"] * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * _tail(F.abs(c["runs"] - mean) / F.sqrt(spread))).otherwise(0.0)
        scatter = n * c["s2"] - c["s1"] * c["s1"]
        lag = (n * c["s11"] - c["s1"] * c["s1"]) / F.nullif(scatter, F.lit(0.0))
        sigma = F.sqrt(n * (n - 3) / (n + 1)) / (n - 1)
        p_serial = F.coalesce(2 * _tail(F.abs(lag + 1 / (n - 1)) / sigma), F.lit(0.0))
        return F.struct(
            *[c[f].alias(f) for f in kept],
            F.when(present > 1, 5).otherwise(3).alias("tests"),
            # of an alphabet of one class the tests over classes are null and don't count
            F.least(p_chi, p_runs, p_serial, p_classes, p_stays).alias("least"),
        )

    def combined(c):
        p = 1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["least"])), c["tests"])
        out = [c[f].alias(f) for f in ("start", "end", "encoding", "token")]
        return F.struct(*out, c["n"].cast("int").alias("n"), p.alias("p"))

    kept = ("start", "end", "encoding", "token", "n")
    for stage in (inferred, counted, summed, scored, combined):
        tokens = F.transform(tokens, stage)
    return tokens


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n) * 2).cast("int")


def thresholds(candidates: DataFrame, rate: float) -> dict[tuple[str, int], float]:
    """Lowest accepted p by encoding and length class; a class without one accepts nothing.

    ``candidates`` has a row for each distinct token. The counts it is read from
    have a row for each encoding, class and bin.
    """
    cells = candidates.groupBy(
        "encoding",
        _length_class(F.col("n")).alias("length"),
        F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
    ).count()
    counts: dict[tuple[str, int], list[int]] = {}
    for r in cells.collect():
        counts.setdefault((r["encoding"], r["length"]), [0] * BINS)[r["bin"]] = r["count"]
    few = {key: bins for key, bins in counts.items() if sum(bins) < LEAST_COUNTED}
    pooled: dict[str, list[int]] = {}
    for (encoding, _), bins in few.items():
        pooled[encoding] = [x + y for x, y in zip(bins, pooled.get(encoding, [0] * BINS))]
    out = {}
    for key, bins in counts.items():
        if key in few:
            bins = pooled[key[0]]
        limit = _limit(bins, rate) if sum(bins) >= LEAST_COUNTED else PRIOR
        if limit is not None:
            out[key] = limit
    return out


def _limit(bins: list[int], rate: float) -> float | None:
    """Lowest threshold at which at most ``rate`` of the accepted are false.

    Twice the count above one half estimates the random ones; its standard error
    (of the count: its root) is taken in their favour.
    """
    high = sum(bins[BINS // 2 :])
    for b in range(1, BINS):
        accepted = sum(bins[b:])
        false = accepted - 2 * (high + high**0.5) * (1 - b / BINS)
        if accepted and false <= rate * accepted:
            return b / BINS
    return None


def secrets(
    docs: DataFrame,
    text_col: str = "text",
    rate: float = 0.1,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with ``found``, an array of ``start``, ``kind`` (place in KINDS) and ``end``, sorted.

    Places are code points, ``end`` exclusive. Within a kind matches don't
    overlap. A ``random`` token that overlaps a match of a pattern isn't listed
    again. ``rate`` bounds the share of false discoveries among distinct random
    tokens, wherever there are enough to tell.

    Defined cases: a null text counts as empty and has an empty array. Ids are
    not used, so null and repeated ids and rows stay as they are. An empty table
    gives an empty table. ``carry`` names the input columns to return, all if not
    given; a column named ``found`` is replaced.
    """
    carry = docs.columns if carry is None else carry
    rows = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = located(rows, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN})
    assigned = F.filter(
        "assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_ASSIGNED
    )
    access = F.filter("access", lambda m: F.length(m["value"]) >= LEAST_ACCESS)

    def spans(matches: Column, kind: int) -> Column:
        return F.transform(
            matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        )

    rows = rows.select(
        "row",
        F.array_sort(F.concat(spans(assigned, 0), spans(access, 1), spans(F.col("hex"), 2))).alias("base"),
        tested(F.col("token")).alias("tokens"),
    )
    rows = materialize(rows, "secrets")
    tokens = rows.select(F.explode("tokens").alias("t")).select("t.encoding", "t.n", "t.token", "t.p")
    limits = thresholds(tokens.distinct(), rate)
    if limits:
        keys = [F.lit(f"{e}:{length}") for e, length in limits]
        table = F.create_map(*[x for k, v in zip(keys, limits.values()) for x in (k, F.lit(v))])
        limit = lambda t: F.try_element_at(
            table, F.concat(t["encoding"], F.lit(":"), _length_class(t["n"]).cast("string"))
        )
        random = F.filter(
            "tokens",
            lambda t: (t["p"] >= limit(t))
            & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
        )
    else:
        random = F.slice("tokens", 1, 0)
    found = F.array_sort(F.concat("base", spans(random, KINDS.index("random"))))
    return unpacked(rows.withColumn("found", found), carry, {"found": F.col("found")})


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )
