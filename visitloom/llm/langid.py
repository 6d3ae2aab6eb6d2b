"""Language identification in two steps: the family, then the language within it.

A text is a bag of hashed byte n-grams of its lower-cased letters. A logistic
regression over families decides first; inside the family one linear support
vector machine for each pair of languages votes. Both are Spark ML models, fitted
on a bounded sample of labelled texts; prediction goes over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import packed, ship, unpacked
from visitloom.session import materialize

# Families of languages by ISO 639-1 code. A language that isn't
# listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "rm", "ro", "sc"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "malayic": ("id", "jv", "ms", "su"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# Labelled texts of each language that are learned from, at most.
SAMPLE_PER_LANGUAGE = 1500
# Steps of each fit; a step is a small job over the sample.
MAX_ITER = 10
BUCKET_BITS = 15
_MULTIPLIER = np.uint32(2654435761)
_PART = 1 << 20  # bytes of a text that are hashed at once
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = "und"


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-byte grams of a text, part by part."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    shift = np.uint32(32 - BUCKET_BITS)
    for at in range(0, len(data), _PART):
        x = np.frombuffer(data[at : at + _PART + 2], np.uint8).astype(np.uint32)
        n = min(_PART, len(data) - at)
        one = x + np.uint32(1)
        two = one[:-1] * np.uint32(259) + x[1:]
        three = two[:-1] * np.uint32(263) + x[2:]
        for gram in (one[:n], two[:n], three[:n]):
            yield (gram * _MULTIPLIER) >> shift


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@F.udf(VectorUDT())
def _vector(text):
    """Shares of the buckets, for the few texts that are learned from."""
    counts = np.zeros(1 << BUCKET_BITS)
    for part in _grams(text):
        counts += np.bincount(part, minlength=len(counts))
    used = np.flatnonzero(counts)
    return SparseVector(len(counts), used, counts[used] / counts.sum())


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct usable texts of each language by a hash, or all if there are fewer.

    A language of at most ``most`` usable rows is taken whole, with its copies;
    of a larger one each text is taken once. Only hashes are counted and
    compared, with a row for each language on the driver; the texts of those
    chosen are fetched after that, and a task sends one copy of each.
    """
    order = F.xxhash64(F.lit("sample"), "text", "lang").alias("order")
    usable = F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    hashes = labelled.where(usable).select("lang", order).groupBy("lang", "order").agg(F.count("*").alias("copies"))
    hashes = materialize(hashes, "language-hashes")
    sizes = hashes.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("copies").alias("rows")).collect()
    if not sizes:
        return labelled.select("lang", "text").limit(0)
    # so far above ``most`` that hashes evenly spread don't fall short of it
    wanted, bound = most + 10 * most**0.5 + 100, 1 << 30
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, wanted / r["texts"]) * bound))])
    whole = [r["lang"] for r in sizes if r["rows"] <= most]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = (
        hashes.where(F.pmod("order", F.lit(bound)) < F.element_at(limits, F.col("lang")))
        .withColumn("place", place)
        .where(F.col("place") <= most)
        .select("lang", "order", F.when(F.col("lang").isin(whole), F.col("copies")).otherwise(1).alias("copies"))
    )
    texts = (
        labelled.select("lang", "text", order)
        .join(F.broadcast(chosen), ["lang", "order"])
        .groupBy("lang", "order", "copies")
        .agg(F.first("text").alias("text"))
    )
    return texts.select("lang", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("lang", "text")


class Model:
    """Weights of both steps, as plain arrays; at most a few MB."""

    def __init__(self, families, family_weights, family_bias, pairs, pair_weights, pair_bias):
        self.families = families  # [(name, [languages])]
        self.weights = np.concatenate([family_weights, pair_weights]).T.astype(np.float32).copy()
        self.bias = np.concatenate([family_bias, pair_bias])
        self.pairs = pairs  # [(first, second)] in the order of the pair weights

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not _has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for part in _grams(text):
            for at in range(0, len(part), 65536):
                total += self.weights[part[at : at + 65536]].sum(axis=0)
            n += len(part)
        score = total / n + self.bias
        k = len(self.families)
        share = np.exp(score[:k] - score[:k].max())
        share /= share.sum()
        best = int(share.argmax())
        languages = self.families[best][1]
        votes = {lang: [0, 0.0, 0.0] for lang in languages}  # wins, confidence, margin
        for (a, b), margin in zip(self.pairs, score[k:].tolist()):
            if a in votes and b in votes:
                sure = 1 / (1 + np.exp(-2 * min(30.0, abs(margin))))
                winner, loser = (a, b) if margin <= 0 else (b, a)
                votes[winner][0] += 1
                votes[winner][2] += abs(margin)
                votes[loser][2] -= abs(margin)
                votes[winner][1] += sure
                votes[loser][1] += 1 - sure
        language = max(languages, key=lambda x: (votes[x][0], votes[x][2], x))
        others = max(1, len(languages) - 1)
        sure = votes[language][1] / others if len(languages) > 1 else 1.0
        return language, float(min(1.0, share[best] * sure))


def fit(labelled: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model from rows (``lang``, ``text``); rows without a language or a letter teach nothing."""
    ship(labelled.sparkSession)
    sample = _sample(labelled, most).repartition(4).select("lang", _vector("text").alias("features"))
    sample = materialize(sample, "language-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    members: dict[str, list[str]] = {}
    for lang in languages:
        members.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    families = sorted(members.items())
    width = 1 << BUCKET_BITS
    family_weights, family_bias = np.zeros((len(families), width)), np.zeros(len(families))
    if len(families) > 1:
        labels = {lang: float(i) for i, (_, own) in enumerate(families) for lang in own}
        model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=MAX_ITER).fit(
            sample.select("features", _label(labels))
        )
        family_weights, family_bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    pairs = [pair for _, own in families for pair in combinations(own, 2)]
    pair_weights, pair_bias = np.zeros((len(pairs), width)), np.zeros(len(pairs))
    for i, (a, b) in enumerate(pairs):
        both = sample.where(F.col("lang").isin(a, b)).select("features", _label({a: 0.0, b: 1.0}))
        svm = LinearSVC(regParam=1e-3, maxIter=MAX_ITER).fit(both)
        pair_weights[i], pair_bias[i] = svm.coefficients.toArray(), svm.intercept
    return Model(families, family_weights, family_bias, pairs, pair_weights, pair_bias)


def _label(labels: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.element_at(table, F.col("lang")).alias("label")


def predictions_udf(model: Model):
    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["lang", "score"],
        )

    return predict


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Each row with ``lang_pred`` and ``score``, from 0 to 1.

    The score is the share of the family times the mean confidence of the
    language's pairs in it. Defined cases: a text that is null or has no letter
    is ``und`` with score 0, as is every text under a model without languages.
    Only the text is used, so null and repeated ids and rows stay as they are.
    An empty table gives an empty table. ``carry`` names the input columns to
    return, all if not given; added columns replace those of their name.
    """
    ship(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rows = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
        predictions_udf(model)(F.col(text_col)).alias("found"),
    )
    return unpacked(rows, carry, {"lang_pred": F.col("found.lang"), "score": F.col("found.score")})


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the ids that nothing is learned from; false for a null id (see ``learnable``)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def learnable(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that may teach: not held out, and with an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != 0, F.lit(False))
