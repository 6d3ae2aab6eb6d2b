"""How far the sources of a language differ in their words, by chunk factorization.

A chunk is what stands between white space, and no term reaches over white space.
So documents are only cut into chunks, whose occurrences are counted document by
document, block by block. The counts are dealt and sorted by chunk; there every
globally distinct chunk is cut into its terms once, and they are joined to its
counts. Dealt and sorted by term, distinct documents and occurrences add up.

A count row belongs to a chunk (or term) and a language: occurrences by source,
how many documents hold it, and which, as long as they are fewer than a term needs
to be kept: with more the number itself decides. So a row is bounded by the sources
and ``least_docs``, and the most frequent chunk has one row a block and language,
however often it occurs. Rows of one key are merged as they are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import shuffle_parts, ship
from visitloom.llm.repetition import blocks
from visitloom.session import materialize

# Runs of letters A-Z and a-z and of all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text whose chunks are counted at once.
BLOCK_BYTES = 16_000_000
# Count rows that are merged at once.
ROWS_AT_ONCE = 200_000
# Sources whose probabilities are compared at once; a language with more has several tiles.
TILE = 256
# Terms that are compared at once.
TERMS_AT_ONCE = 2048

_COUNTS = "key string, lang int, counts binary"
_SUMS = "lang string, tile_a int, tile_b int, n_terms long, at_a int, at_b int, value long"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs that begin at ``starts``."""
    done = np.cumsum(sizes) - sizes
    return np.repeat(starts - done, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Counts:
    """Count rows, sorted by (key, lang). ``docs`` holds none for a row of enough documents."""

    key: np.ndarray  # places in ``names``
    names: pa.Array
    lang: np.ndarray
    n_docs: np.ndarray  # documents, each counted once a chunk
    most: np.ndarray  # distinct documents are at least so many
    n_sources: np.ndarray
    source: np.ndarray  # (of all rows, one after the other)
    n: np.ndarray
    n_listed: np.ndarray
    docs: np.ndarray

    def batch(self) -> pa.RecordBatch:
        """Counts as 64-bit numbers: n_docs, most, sources, the sources, their counts, documents."""
        size = 3 + 2 * self.n_sources + self.n_listed
        ends = np.cumsum(size)
        at = ends - size
        flat = np.empty(int(size.sum()), np.int64)
        flat[at], flat[at + 1], flat[at + 2] = self.n_docs, self.most, self.n_sources
        flat[_ragged(at + 3, self.n_sources)] = self.source
        flat[_ragged(at + 3 + self.n_sources, self.n_sources)] = self.n
        flat[_ragged(at + 3 + 2 * self.n_sources, self.n_listed)] = self.docs
        offsets = pa.py_buffer(np.r_[0, ends * 8].astype(np.int32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(flat.tobytes())])
        columns = [self.names.take(pa.array(self.key)), pa.array(self.lang.astype(np.int32)), packed]
        return pa.RecordBatch.from_arrays(columns, ["key", "lang", "counts"])

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "Counts":
        coded, packed = batch.column(0).dictionary_encode(), batch.column(2)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        flat = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
        at = (offsets[:-1].astype(np.int64) - offsets[0]) // 8
        size = np.diff(offsets).astype(np.int64) // 8
        n_sources = flat[at + 2]
        n_listed = size - 3 - 2 * n_sources
        return cls(
            np.asarray(coded.indices).astype(np.int64), coded.dictionary,
            np.asarray(batch.column(1)).astype(np.int64), flat[at], flat[at + 1], n_sources,
            flat[_ragged(at + 3, n_sources)], flat[_ragged(at + 3 + n_sources, n_sources)],
            n_listed, flat[_ragged(at + 3 + 2 * n_sources, n_listed)],
        )

    def rows(self, of: np.ndarray) -> "Counts":
        sources = _ragged((np.cumsum(self.n_sources) - self.n_sources)[of], self.n_sources[of])
        docs = _ragged((np.cumsum(self.n_listed) - self.n_listed)[of], self.n_listed[of])
        return Counts(
            self.key[of], self.names, self.lang[of], self.n_docs[of], self.most[of], self.n_sources[of],
            self.source[sources], self.n[sources], self.n_listed[of], self.docs[docs],
        )

    def merged(self, least: int, disjoint: bool) -> "Counts":
        """One row for each key and language. ``disjoint``: no document is in two rows of a key."""
        rows = self.rows(np.lexsort((self.lang, self.key)))
        new = np.r_[True, (rows.key[1:] != rows.key[:-1]) | (rows.lang[1:] != rows.lang[:-1])]
        first, into = np.flatnonzero(new), np.cumsum(new) - 1
        n_docs = np.add.reduceat(rows.n_docs, first)
        most = n_docs.copy() if disjoint else np.maximum.reduceat(rows.most, first)
        of = np.repeat(into, rows.n_sources)
        order = np.lexsort((rows.source, of))
        of, source, n = of[order], rows.source[order], rows.n[order]
        start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (source[1:] != source[:-1])])
        listing = np.repeat(into, rows.n_listed)
        use = most[listing] < least
        listing, docs = listing[use], rows.docs[use]
        if not disjoint:
            order = np.lexsort((docs, listing))
            listing, docs = listing[order], docs[order]
            once = np.r_[True, (listing[1:] != listing[:-1]) | (docs[1:] != docs[:-1])][: len(docs)]
            listing, docs = listing[once], docs[once]
            most = np.maximum(most, np.bincount(listing, minlength=len(first)))
            listing, docs = listing[most[listing] < least], docs[most[listing] < least]
        return Counts(
            rows.key[first], rows.names, rows.lang[first], n_docs, most,
            np.bincount(of[start], minlength=len(first)), source[start], np.add.reduceat(n, start),
            np.bincount(listing, minlength=len(first)), docs,
        )


def _chunk_counts(least: int):
    """Arrow function over (lang, source, text): count rows of the chunks of each block."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(2), BLOCK_BYTES):
                lang, source = (np.asarray(batch.column(i).slice(at, len(texts))).astype(np.int64) for i in (0, 1))
                at += len(texts)
                counted = _block(lang, source, texts, block << 24, least)
                block += 1
                if counted is not None:
                    yield counted.batch()

    return counts


def _block(lang: np.ndarray, source: np.ndarray, texts: pa.Array, doc_base: int, least: int) -> Counts | None:
    by_source = np.lexsort((source, lang))  # documents of a language and source lie side by side
    place = np.empty(len(by_source), np.int64)
    place[by_source] = np.arange(len(by_source))
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = np.asarray(pc.binary_length(words)) > 0  # leading and trailing white space
    code = words.dictionary_encode()
    doc = np.repeat(place, np.diff(np.asarray(split.offsets)))[full]
    key = np.asarray(code.indices).astype(np.int64)[full] * len(texts) + doc
    if not len(key):
        return None
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])  # occurrences of a chunk in a document
    chunk, doc = np.divmod(key[first], len(texts))
    lang, source = lang[by_source][doc], source[by_source][doc]
    new_row = np.r_[True, (chunk[1:] != chunk[:-1]) | (lang[1:] != lang[:-1])]
    new_source = new_row | np.r_[True, source[1:] != source[:-1]]
    rows, pairs = np.flatnonzero(new_row), np.flatnonzero(new_source)
    row = np.cumsum(new_row) - 1
    n_docs = np.diff(np.r_[rows, len(doc)])
    listed = n_docs[row] < least
    return Counts(
        chunk[rows], code.dictionary, lang[rows], n_docs, n_docs,
        np.bincount(row[pairs]), source[pairs], np.add.reduceat(count, pairs),
        np.where(n_docs < least, n_docs, 0), doc_base + doc[listed],
    )


def _by_key(least: int, disjoint: bool, done: Callable[[Counts], pa.RecordBatch]):
    """Arrow function over count rows sorted by key: ``done`` of the merged rows of whole keys."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            rows = Counts.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0]).merged(least, disjoint)
            open_key = len(rows.key) if last else int(np.searchsorted(rows.key, rows.key[-1]))
            if open_key:
                yield done(rows.rows(np.arange(open_key)))
            held = [] if last else [rows.rows(np.arange(open_key, len(rows.key))).batch()]
            n = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield from flush(False)
        if held:
            yield from flush(True)

    return merge


_TERM = re.compile(TERM)
_LOWER = str.maketrans(UPPER, LOWER)


def _terms_of(chunks: Counts) -> pa.RecordBatch:
    """The chunks' rows once for each of their terms."""
    place: dict[str, int] = {}
    term, times, size = [], [], []
    for chunk in chunks.names.to_pylist():
        found = [t.translate(_LOWER) for t in _TERM.findall(chunk)]
        own = dict.fromkeys(found)
        term += [place.setdefault(t, len(place)) for t in own]
        times += [found.count(t) for t in own] if len(own) < len(found) else [1] * len(found)
        size.append(len(own))
    size, term, times = (np.array(x, np.int64) for x in (size, term, times))
    start = np.cumsum(size) - size
    each = size[chunks.key]
    out = chunks.rows(np.repeat(np.arange(len(chunks.key)), each))
    at = _ragged(start[chunks.key], each)
    out.key, out.names = term[at], pa.array(list(place), pa.string())
    out.n = out.n * np.repeat(times[at], out.n_sources)
    return out.batch()


def _kept(least: int):
    """Arrow function: (lang, source, term, n) of the terms in enough documents."""

    def kept(terms: Counts) -> pa.RecordBatch:
        rows = terms.rows(np.flatnonzero(terms.most >= least))
        columns = [
            pa.array(np.repeat(rows.lang, rows.n_sources), pa.int32()),
            pa.array(rows.source, pa.int32()),
            rows.names.take(pa.array(np.repeat(rows.key, rows.n_sources))),
            pa.array(rows.n),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang_no", "number", "term", "n"])

    return kept


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences of all sources of two tiles over the task's terms.

    A row has the probabilities of a term that occur (``at``, ``p``) and, for its
    language and pair of tiles, those of a term that does not (``rest``).
    """
    sums: dict[tuple[str, int, int], list] = {}
    for batch in batches:
        lang, a, b, at, p, rest = (batch.column(n) for n in ("lang", "tile_a", "tile_b", "at", "p", "rest"))
        kind = pa.StructArray.from_arrays([lang, a, b], ["lang", "a", "b"])
        names = kind.to_pylist()
        rows: dict[tuple[str, int, int], list[int]] = {}
        for i, name in enumerate(names):
            rows.setdefault((name["lang"], name["a"], name["b"]), []).append(i)
        for key, of in rows.items():
            own = pa.array(of)
            base = np.asarray(rest[of[0]].values)
            found, value = at.take(own), p.take(own)
            where = np.repeat(np.arange(len(of)), np.asarray(pc.list_value_length(found)))
            table = np.tile(base, (len(of), 1))
            table[where, np.asarray(found.flatten())] = np.asarray(value.flatten())
            total = sums.setdefault(key, [np.zeros((len(base), len(base)), np.int64), 0])
            total[1] += len(of)
            for i in range(0, len(of), TERMS_AT_ONCE):
                part = table[i : i + TERMS_AT_ONCE]
                for s in range(len(base)):
                    total[0][s] += np.abs(part - part[:, s : s + 1]).sum(axis=0)
    for (lang, a, b), (total, n) in sums.items():
        x, y = (i.ravel() for i in np.indices(total.shape))
        columns = [
            pa.array([lang] * len(x), pa.string()),
            *[pa.array(np.full(len(x), v), t) for v, t in ((a, pa.int32()), (b, pa.int32()), (n, pa.int64()))],
            pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total.ravel()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "tile_a", "tile_b", "n_terms", "at_a", "at_b", "value"])


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """Occurrences ``n`` of each term that at least ``least_docs`` documents of its language hold.

    ``docs`` has numbers for language (``lang_no``) and source (``number``), and ``text``;
    so has the result, with ``term`` in place of the text, for each source that has the term.
    """
    ship(docs.sparkSession)
    parts = shuffle_parts(docs.sparkSession)
    chunks = (
        docs.select("lang_no", "number", "text").mapInArrow(_chunk_counts(least_docs), _COUNTS)
        .repartition(parts, "key").sortWithinPartitions("key")
    )
    terms = (
        chunks.mapInArrow(_by_key(least_docs, True, _terms_of), _COUNTS)
        .repartition(parts, "key", "lang").sortWithinPartitions("key")
    )
    return terms.mapInArrow(
        _by_key(least_docs, False, _kept(least_docs)), "lang_no int, number int, term string, n long"
    )


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 30,
    scale: int = 1_000_000_000,
    added: int = 5,
    top_terms: int = 50,
) -> DataFrame:
    """How each source of a language differs from the others, and its most typical terms.

    The terms of a language are those in at least ``least_docs`` of its documents,
    V of them. A term that occurs n times among N occurrences of terms has
    p = 1 + floor(scale * (n + added) / (N + added * V)), exact whole numbers. Rows
    are ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` from 1 by
    falling value, then by item in the order of its UTF-8 bytes. Part ``pair``:
    each other source of the language, and the sum of the absolute differences of
    p over all its terms. Part ``term``: up to ``top_terms`` terms of the source
    whose p is above the language's, and by how much.

    Defined cases: a null text, language or source counts as empty. Each row is a
    document, repeated ones too. A group without terms is compared like others; a
    language without terms has value 0 in its pairs. An empty table gives an empty
    table. Other columns are not read.
    """
    keys = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    # one row for each language and source: the result has the square of their number
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select(*keys).distinct().withColumn("number", numbered)
    langs = groups.select("lang").distinct().withColumn("lang_no", F.row_number().over(Window.orderBy("lang")))
    groups = materialize(groups.join(F.broadcast(langs), "lang"), "numbers")
    plain = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = term_counts(plain.join(F.broadcast(groups), ["lang", "source"]), least_docs)
    cells = materialize(found.join(F.broadcast(groups), ["lang_no", "number"]), "cells")
    per_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_term = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    per_lang = per_term.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    cells = cells.select("lang", "source", "term", "n").join(per_term, ["lang", "term"])

    def p(count, total):
        of = (F.lit(scale).cast("decimal(12,0)") * (count + F.lit(added)).cast("decimal(20,0)"))
        space = (total + F.lit(added) * F.col("n_terms")).cast("decimal(20,0)")
        return F.when(F.col("n_terms") > 0, F.lit(1).cast("long") + F.call_function("div", of, space))

    groups = materialize(
        groups.join(per_source, ["lang", "source"], "left")
        .join(per_lang, "lang", "left")
        .na.fill(0, ["total", "lang_total", "n_terms"])
        .withColumn("rest", p(F.lit(0), F.col("total")))
        .withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
        .withColumn("at", (F.col("number") % TILE).cast("int")),
        "groups",
    )
    valued = cells.join(F.broadcast(groups.drop("rest")), ["lang", "source"]).withColumn(
        "p", p(F.col("n"), F.col("total"))
    )

    least = (F.col("p") - p(F.col("lang_n"), F.col("lang_total"))).alias("value")
    typical = valued.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), least)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = typical.where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {top_terms}")

    # each tile meets itself and every later one, the two laid side by side
    tiles = F.broadcast(
        groups.groupBy("lang", "tile").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "rest"))), lambda s: s["rest"]).alias("rest")
        )
    )
    a, b = (tiles.select("lang", F.col("tile").alias(f"tile_{s}"), F.col("rest").alias(f"rest_{s}")) for s in "ab")
    met = a.join(b, "lang").where("tile_a <= tile_b").withColumn(
        "rest", F.when(F.col("tile_a") == F.col("tile_b"), F.col("rest_a")).otherwise(F.concat("rest_a", "rest_b"))
    )
    met = met.withColumn("beyond", F.size("rest_a")).select("lang", "tile_a", "tile_b", "beyond", "rest")
    side = (F.col("tile") == F.col("tile_a")) | (F.col("tile") == F.col("tile_b"))
    laid = F.col("at") + F.when(F.col("tile") == F.col("tile_a"), 0).otherwise(F.col("beyond"))
    rows = (
        valued.join(F.broadcast(met.drop("rest")), "lang").where(side)
        .withColumn("cell", F.struct(laid.alias("at"), "p"))
        .groupBy("lang", "tile_a", "tile_b", "term")
        .agg(F.collect_list("cell").alias("cells"))  # at most 2 * TILE
        .join(F.broadcast(met.drop("beyond")), ["lang", "tile_a", "tile_b"])
        .select("lang", "tile_a", "tile_b", F.col("cells.at").alias("at"), F.col("cells.p").alias("p"), "rest")
    )
    sums = (
        rows.mapInArrow(_distances, _SUMS)
        .groupBy("lang", "tile_a", "tile_b", "at_a", "at_b")
        .agg(F.sum("value").alias("met"), F.sum("n_terms").alias("n_met"))
    )
    one = groups.select("lang", "source", "n_terms", *[F.col(c).alias(f"{c}_1") for c in ("tile", "at", "rest")])
    two = groups.select("lang", F.col("source").alias("item"), *[F.col(c).alias(f"{c}_2") for c in ("tile", "at", "rest")])
    # the pairs of sources are the result itself
    pairs = one.join(two, "lang").where("source != item").withColumn("tile_a", F.least("tile_1", "tile_2")).withColumn(
        "tile_b", F.greatest("tile_1", "tile_2")
    )

    def seat(side: str):
        later = (F.col("tile_a") != F.col("tile_b")) & (F.col(f"tile_{side}") == F.col("tile_b"))
        return F.col(f"at_{side}") + F.when(later, F.lit(TILE)).otherwise(0)

    pairs = (
        pairs.withColumn("at_a", seat("1")).withColumn("at_b", seat("2"))
        .join(sums, ["lang", "tile_a", "tile_b", "at_a", "at_b"], "left")
        .select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            # terms that none of the sources of both tiles has
            F.coalesce(
                F.coalesce("met", F.lit(0))
                + (F.col("n_terms") - F.coalesce("n_met", F.lit(0))) * F.abs(F.col("rest_1") - F.col("rest_2")),
                F.lit(0),
            ).cast("long").alias("value"),
        )
        .withColumn("rank", F.row_number().over(ranked))
    )
    return pairs.unionByName(typical)
