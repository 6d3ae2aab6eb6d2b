"""Quality rules on repetition, from suffix arrays.

The suffixes of a text, as sequences of words, are sorted by prefix doubling.
Neighbours in that order share their longest common prefix; a stretch of
neighbours that share at least some length is an interval of the array and its
prefix a repeated passage, maximal to the right when the length is that of the
interval. Each position takes the longest prefix it shares, the spans of all
positions are united, and rules limit how much of a text they cover and how long
one passage is.

Texts are handled in blocks of whole documents: a block's suffixes are sorted at
once, with the document as first sort key. Memory is a few dozen bytes a word of
the block, and a block holds one document at least.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import packed, ship, unpacked

# Words of a window that counts as repeated in the base figures.
WINDOW = 3
# Largest share of the words in repeats of at least so many words. Chosen on sf0.1:
# of the texts that pass the base 99 in 100 have at most 0.11 at any of these lengths;
# of those that fail it on repeats 9 in 10 have at least 0.85.
GRADES = {5: 0.20, 6: 0.19, 8: 0.18, 10: 0.15, 13: 0.12, 16: 0.10}
BLOCK_BYTES = 2_000_000
_HAS_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"

FIGURES = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("covered_words", pa.int64()),
        ("longest_repeat", pa.int64()),
        ("graded_words", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_FIGURES_DDL = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,covered_words:bigint,longest_repeat:bigint,"
    "graded_words:array<bigint>,spans:array<struct<start:bigint,end:bigint>>>"
)


def longest_shared(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the longest prefix its suffix shares with another of its text.

    ``symbols`` differ between texts; ``ends`` holds the end of the text of each
    position.
    """
    n = len(symbols)
    shared = np.zeros(n, np.int64)
    if not n:
        return shared
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int32)
    fresh = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.r_[fresh[1:], True]
    live = order[~alone]  # positions whose prefix isn't unique yet, in sorted order
    levels, step = [rank], 1
    while len(live):
        after = live + step
        inside = after < ends[live]
        second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        first = rank[live].astype(np.int64)
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        live, key, first = live[by], key[by], first[by]
        new_group = np.r_[True, first[1:] != first[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(live))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        key_start = np.maximum.accumulate(np.where(new_key, at, 0))
        rank = rank.copy()
        rank[live] = first + key_start - group_start
        alone = new_key & np.r_[new_key[1:], True]
        live = live[~alone]
        step *= 2
        if len(live):
            levels.append(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < ends[a]) & (y < ends[b])
        level = levels[i]
        length += (inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])) * (1 << i)
    np.maximum.at(shared, a, length)
    np.maximum.at(shared, b, length)
    return shared


def _covered(shared: np.ndarray, least: int) -> np.ndarray:
    at = np.flatnonzero(shared >= least)
    change = np.zeros(len(shared) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + shared[at], -1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets)
    words = split.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    kept = np.r_[0, np.cumsum(full)]
    return words.filter(pa.array(full)), kept[offsets - offsets[0]]


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    split = pc.split_pattern(texts, "\n")
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    lines = split.flatten().dictionary_encode()
    filled = np.asarray(pc.match_substring_regex(lines.dictionary, _HAS_WORD).cast(pa.uint8()))
    code = np.asarray(lines.indices).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    doc, code = doc[filled[code] > 0], code[filled[code] > 0]
    distinct = np.unique(doc * len(filled) + code) // max(1, len(filled))
    n = len(texts)
    return np.bincount(doc, minlength=n) - np.bincount(distinct, minlength=n)


def _figures(texts: pa.Array, least: int, lengths: Sequence[int]) -> pa.Array:
    texts = pc.fill_null(texts, "")
    words, offsets = _words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = words.dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    shared = longest_shared(doc * (len(coded.dictionary) + 1) + code, offsets[1:][doc])
    covered = _covered(shared, least)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, shared)
    edge = np.diff(np.r_[False, covered, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a span that runs over the end of a text is one for each text
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(covered))]
    cuts = np.unique(cuts[covered[cuts - 1] & covered[cuts]]) if len(cuts) else cuts
    starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    owner = doc[starts] if len(starts) else np.empty(0, np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array(starts - offsets[owner]), pa.array(ends - offsets[owner])], ["start", "end"]
    )
    per = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))]
    columns = [
        np.diff(offsets),
        _sums(np.asarray(pc.utf8_length(words)), offsets),
        np.asarray(pc.count_substring_regex(texts, _SYMBOLS)),
        _repeated_lines(texts),
        _sums(_covered(shared, WINDOW), offsets),
        _sums(covered, offsets),
        longest,
    ]
    arrays = [pa.array(c.astype(np.int64)) for c in columns]
    graded = np.array([_sums(_covered(shared, n), offsets) for n in lengths], np.int64).reshape(-1, len(texts))
    cells = pa.array(np.arange(len(texts) + 1) * len(lengths), pa.int32())
    arrays.append(pa.ListArray.from_arrays(cells, pa.array(graded.T.ravel())))
    arrays.append(pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans))
    return pa.StructArray.from_arrays(arrays, fields=list(FIGURES))


def blocks(texts: pa.Array, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``most_bytes``, one text at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > most_bytes:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield texts.slice(start)


def figures_udf(least: int, lengths: Sequence[int]):
    @F.arrow_udf(_FIGURES_DDL)
    def figures(texts: pa.Array) -> pa.Array:
        parts = [_figures(part, least, lengths) for part in blocks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], FIGURES)

    return figures


def repetition(
    docs: DataFrame,
    text_col: str = "text",
    least_repeat: int = 16,
    max_covered: float = 0.3,
    max_repeat: int = 100,
    grades: Mapping[int, float] = GRADES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with the base figures, the repeated spans and the verdict of the rules.

    Adds ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line),
    ``n_repeat_words`` (words in windows of three that occur twice or more),
    ``spans`` (word positions of the united repeats of at least ``least_repeat``
    words), ``covered_words``, ``longest_repeat`` (words), ``graded_words`` (words in
    repeats of at least each length of ``grades``, in its order) and ``repetitive``:
    the spans cover more than ``max_covered`` of the words, a passage of more than
    ``max_repeat`` words repeats, or repeats of at least a length of ``grades``
    cover more than its share.

    Defined cases: a null, empty or blank text has all figures 0 and isn't
    repetitive. A passage that overlaps its own copy counts as repeated. Ids are
    not used, so null and repeated ids and rows stay as they are. ``carry`` names
    the input columns to return, all if not given; added columns replace those
    of their name. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rows = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
        figures_udf(least_repeat, list(grades))(F.col(text_col)).alias("found"),
    )
    made = {f.name: F.col("found")[f.name] for f in FIGURES}
    repetitive = (made["covered_words"] > made["n_words"] * F.lit(max_covered)) | (
        made["longest_repeat"] > max_repeat
    )
    for i, share in enumerate(grades.values()):
        repetitive |= made["graded_words"][i] > made["n_words"] * F.lit(share)
    return unpacked(rows, carry, made | {"repetitive": repetitive})


def judged(docs: DataFrame, carry: list[str] | None = None, **rules) -> DataFrame:
    """``repetition`` with ``base_failed`` and ``kept``.

    A text fails the base with fewer than 50 words, or with over half of its
    words in repeated windows; it is kept if it passes that and isn't repetitive.
    """
    found = repetition(docs, carry=carry, **rules)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("repetitive")
    )


def accepted(docs: DataFrame, **rules) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    row = docs.select(packed(docs).alias("row"), F.col(rules.pop("text_col", "text")).alias("text"))
    kept = judged(row, carry=["row"], **rules).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
