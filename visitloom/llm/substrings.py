"""Removal of repeated byte strings, by suffix sorting over a cover of sampled positions.

A suffix matters here up to ``length`` bytes. Positions are sampled so that two equal
strings of that length always hold a sample at the same distance from their starts,
which is what a difference cover is for; a cover chosen by content (the least hash of
the strings of ``GRAM`` bytes in reach) needs one position in 80 or so, a cover of
residues modulo 3 needs two in three, or twelve bytes of shuffle for each byte of text.

1. Sampled positions are dealt by the bytes that begin there. Where no other text or
   place has the same, no repeated string can hold the sample: it is left out.
2. The others take their surroundings along. In each range the sampled suffixes are
   sorted: triples of 8-byte units are sorted and named, triples of names are sorted
   and named, until one name stands for the whole suffix.
3. The remaining suffixes, those that start before a sample, are merged in: their
   order is that of the bytes up to the sample, then of the sample's suffix.
4. Neighbours whose common prefix is ``length`` bytes or more are repeated.

A sample that very many places share is dealt over several runs. What is repeated
within a run is known there; for the rest the runs' distinct strings meet, a row
each, so that no string has more rows than there are runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import packed, shuffle_parts, ship, unpacked
from visitloom.session import materialize

# Bytes at a sampled position that choose it and deal it out.
GRAM = 48
# Bytes of text that are sampled at once; longer texts are sampled piece by piece.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)  # of a byte in a block
# Samples that are compared at once, and bytes of surroundings in a batch.
ROWS_AT_ONCE = 8192
BATCH_BYTES = 4_000_000
# A run holds this share of a task's fair share of samples, but not less than ...
RUNS_PER_TASK = 4
LEAST_RUN = 1024

_SAMPLES = "h long, key binary, lo long, ahead int, starts int"
_NEAR = "h long, run int, hot boolean, key binary, lo long, ahead int, starts int, near binary"
_FOUND = "key binary, start long, end long, digest binary, single boolean"
_RESULT = "key binary, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept_sha256 string"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    base, inverse = 0x9E3779B97F4A7C15, 1
    for _ in range(6):
        inverse = inverse * (2 - base * inverse) % 2**64
    n = 2 * BLOCK
    return tuple(np.cumprod(np.full(n, b, np.uint64)) for b in (base, inverse))


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each byte on."""
    up, down = _powers()
    done = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=done[1:])
    h = (done[gram:] - done[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def _samples_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Samples of texts that lie in ``data``: hash, text, first start, place and number of starts.

    The starts of a sample are the places from which it is the chosen one.
    """
    reach = length - gram + 1
    sizes = ends - begins - length + 1
    at = np.flatnonzero(sizes > 0)
    if not len(at):
        return None
    h = _hashes(data, gram)
    # by the hash; of equal ones the first. The place takes the low bits.
    order = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    n = len(order) - reach + 1
    rows = np.concatenate([order, np.full(-len(order) % reach + reach, 2**64 - 1, np.uint64)]).reshape(-1, reach)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(backward[:n], forward[reach - 1 : reach - 1 + n]) & _PLACE).astype(np.int64)
    sizes, begin = sizes[at], begins[at]
    text = np.repeat(at, sizes)
    start = np.arange(len(text)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    place = chosen[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    return h[place[first]].view(np.int64), text[first], start[first], place[first], np.diff(np.r_[first, len(text)])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _within_text(data: np.ndarray, h, text, start, place, n, length: int):
    """Samples of one text with equal surroundings: all but the first, and the spans they repeat."""
    order = np.lexsort((start, h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = order[np.r_[same, False] | np.r_[False, same]]
    known, spans, drop = {}, {}, np.zeros(len(h), bool)
    for i in many.tolist():
        end = int(start[i] + n[i]) + length - 1
        about = (int(text[i]), int(place[i] - start[i]), data[start[i] : end].tobytes())
        other = known.setdefault(about, i)
        if other != i:
            drop[i] = True
            own = spans.setdefault(int(text[i]), [])
            own.append((int(start[i]), end))
            own.append((int(start[other]), int(start[other] + n[other]) + length - 1))
    return drop, {t: _merged(s) for t, s in spans.items()}


def _samples(length: int, gram: int):
    """Arrow function over (key, body): rows of ``_SAMPLES``.

    A row without hash is a span [lo, lo + starts) that the text itself repeats.
    """

    def pieces(keys: pa.Array, bodies: pa.Array) -> Iterator[tuple]:
        """(data, begins, ends, keys, offset of the data in the text) of about a block."""
        data = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        names, i = keys.to_pylist(), 0
        while i < len(names):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            if j == i + 1:
                # starts are dealt over pieces, so a piece reaches into the next one
                for at in range(0, max(1, int(offsets[j] - offsets[i]) - length + 1), BLOCK):
                    end = min(int(offsets[j]), int(offsets[i]) + at + BLOCK + length - 1)
                    part = data[int(offsets[i]) + at : end]
                    yield part, np.array([0]), np.array([len(part)]), names[i:j], at
            else:
                part, seen = data[offsets[i] : offsets[j]], {}
                for t in range(i, j):
                    seen.setdefault(names[t], t)  # a copy in the same block has the same samples
                of = np.array(sorted(seen.values()))
                yield part, offsets[of] - offsets[i], offsets[of + 1] - offsets[i], [names[t] for t in of], 0
            i = j

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, begins, ends, keys, offset in pieces(batch.column(0), batch.column(1)):
                found = _samples_of(data, begins, ends, length, gram) if len(data) >= length else None
                if found is None:
                    continue
                h, text, start, place, n = found
                drop, spans = _within_text(data, h, text, start, place, n, length)
                keep = np.flatnonzero(~drop)
                known = [(t, a, b - a) for t, own in spans.items() for a, b in own]
                of = np.r_[text[keep], [k[0] for k in known]].astype(np.int64)
                lo = np.r_[start[keep], [k[1] for k in known]].astype(np.int64) - begins[of] + offset
                columns = [
                    pa.array(np.r_[h[keep], np.zeros(len(known), np.int64)], mask=np.arange(len(of)) >= len(keep)),
                    pa.array(keys, pa.binary()).take(pa.array(of)),
                    pa.array(lo),
                    pa.array(np.r_[(place - start)[keep], np.full(len(known), -1)].astype(np.int32)),
                    pa.array(np.r_[n[keep], [k[2] for k in known]].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "key", "lo", "ahead", "starts"])

    return samples


def _table(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _by_class(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole classes of batches sorted by (h, run), and at which rows they begin."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < rows_at_once:
            continue
        whole = _table(held)
        first = _classes(whole)
        held, n = [whole.slice(first[-1])], whole.num_rows - int(first[-1])
        if len(first) > 1:
            yield whole.slice(0, first[-1]), first[:-1]
    if held:
        whole = _table(held)
        yield whole, _classes(whole)


def _classes(rows: pa.RecordBatch) -> np.ndarray:
    h, run = np.asarray(rows.column("h")), np.asarray(rows.column("run"))
    return np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (run[1:] != run[:-1])])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of samples sorted by (h, run, key, lo), once each, those in classes of several, and all of hot ones."""
    for rows, first in _by_class(batches, 50_000):
        key = rows.column("key").dictionary_encode().indices
        lo, of = np.asarray(rows.column("lo")), np.repeat(np.arange(len(first)), np.diff(np.r_[first, rows.num_rows]))
        key = np.asarray(key)
        new = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])]
        several = np.add.reduceat(new, first) > 1
        hot = np.asarray(rows.column("hot").cast(pa.uint8())) > 0
        yield rows.take(pa.array(np.flatnonzero(new & (several[of] | hot))))


def _near(length: int):
    """Arrow function over (key, copies, body, marks): the marked samples with their surroundings."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _NEAR.split(", ")]
        for batch in batches:
            rows, size = [], 0
            for key, _, body, marks in zip(*batch.columns):
                key, body = key.as_py(), memoryview(body.as_buffer())
                for m in marks.as_py():
                    part = bytes(body[m["lo"] : m["lo"] + m["starts"] - 1 + length])
                    rows.append((m["h"], m["run"], m["hot"], key, m["lo"], m["ahead"], m["starts"], part))
                    size += len(part)
                    if size > BATCH_BYTES:
                        yield _rows(rows, names)
                        rows, size = [], 0
            if rows:
                yield _rows(rows, names)

    return near


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _named(triples: np.ndarray) -> np.ndarray:
    """Names of triples, in their order."""
    a, b, c = triples.T
    order = np.lexsort((c, b, a))
    triples = triples[order]
    new = np.r_[False, (triples[1:] != triples[:-1]).any(axis=1)]
    names = np.empty(len(order), np.uint64)
    names[order] = np.cumsum(new)
    return names


def _sorted(strings: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within their class, and what each shares with the one before (-1: another class)."""
    m = len(strings)
    names = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    while names.shape[1] > 1:
        names = np.pad(names, ((0, 0), (0, -names.shape[1] % 3)))
        names = _named(names.reshape(-1, 3)).reshape(m, -1)
    order = np.lexsort((names[:, 0], of))
    strings, of = strings[order], of[order]
    differ = strings[1:] != strings[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, np.r_[-1, np.where(of[1:] == of[:-1], shared, -1)]


def _strings(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """Rows of ``sizes`` bytes from ``first`` on, forward or backward, filled up with zeros."""
    width = max(8, -(-int(sizes.max()) // 8) * 8)
    out = np.zeros((len(sizes), width), np.uint8)
    column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), column] = flat[np.repeat(first, sizes) + step * column]
    return out


def _compared(length: int):
    """Arrow function over rows of ``_NEAR`` sorted by (h, run): rows of ``_FOUND``.

    Without digest: a span of repeated strings. With digest, for samples dealt over
    runs: a distinct string of this run, and whether the run holds it once only.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _by_class(batches, ROWS_AT_ONCE):
            m = rows.num_rows
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, m]))
            near = rows.column("near")
            offsets = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + m + 1].astype(np.int64)
            flat = np.frombuffer(near.buffers()[2], np.uint8)
            lo, ahead, starts = (np.asarray(rows.column(c)).astype(np.int64) for c in ("lo", "ahead", "starts"))
            hot = np.asarray(rows.column("hot").cast(pa.uint8())) > 0
            sample = offsets[:-1] + ahead
            order, shared = _sorted(_strings(flat, sample, offsets[1:] - sample, 1), of)
            left_order, left_shared = _sorted(_strings(flat, sample - 1, ahead, -1), of)
            group, left_group = np.empty(m, np.int64), np.empty(m, np.int64)
            repeated = np.zeros((m, int(ahead.max()) + 2), bool)
            one, two = [], []  # hot: rows that stand for a string of the run, and whether alone
            for x in range(int(ahead.max()) + 1):  # suffixes that start x bytes before the sample
                own = np.flatnonzero((x <= ahead) & (x > ahead - starts))
                if not len(own):
                    continue
                group[order] = np.cumsum(shared < length - x)
                left_group[left_order] = np.cumsum(left_shared < x)
                suffix = left_group[own] * (m + 1) + group[own]
                merged = np.argsort(suffix, kind="stable")
                same = suffix[merged][1:] == suffix[merged][:-1]
                of_several = np.r_[same, False] | np.r_[False, same]
                repeated[own[merged[of_several]], x] = True
                if hot.any():
                    stands = np.r_[True, ~same]
                    rep = own[merged[stands]]
                    alone = ~of_several[stands]
                    one.append(np.c_[rep, np.full(len(rep), x)][hot[rep]])
                    two.append(alone[hot[rep]])
            yield from _found(rows, length, lo + ahead, repeated, one, two, offsets, flat, ahead)

    return compared


def _found(rows, length, place, repeated, one, two, offsets, flat, ahead) -> Iterator[pa.RecordBatch]:
    edge = np.diff(repeated.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1  # inclusive; the last column is never set
    key = rows.column("key")
    names = [c.split()[0] for c in _FOUND.split(", ")]
    if len(row):
        yield pa.RecordBatch.from_arrays([
            key.take(pa.array(row)), pa.array(place[row] - high), pa.array(place[row] - low + length),
            pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.bool_()),
        ], names)
    for pairs, alone in zip(one, two):
        if len(pairs):
            row, x = pairs.T
            begin = offsets[row] + ahead[row] - x
            digests = [hashlib.blake2b(flat[b : b + length].tobytes(), digest_size=20).digest() for b in begin.tolist()]
            start = place[row] - x
            yield pa.RecordBatch.from_arrays([
                key.take(pa.array(row)), pa.array(start), pa.array(start + length),
                pa.array(digests, pa.binary()), pa.array(alone),
            ], names)


def _cut(length: int, with_text: bool):
    """Arrow function over (key, copies, body, spans): rows of ``_RESULT``, and what is kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept_bytes = [], []
            for key, copies, body, spans in zip(*batch.columns):
                body, n = memoryview(body.as_buffer()), len(body.as_buffer())
                if copies.as_py() > 1 and n >= length:
                    removed = [(0, n)]  # each string of it starts in the copies too
                else:
                    removed = _merged([(s["start"], s["end"]) for s in spans.as_py() or ()])
                sha, at, parts = hashlib.sha256(), 0, []
                for start, end in [*removed, (n, n)]:
                    sha.update(body[at:start])
                    if with_text:
                        parts.append(body[at:start])
                    at = end
                out.append((key.as_py(), n, [{"start": a, "end": b} for a, b in removed], sha.hexdigest()))
                kept_bytes.append(b"".join(parts))
            if out:
                kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                names = ["key", "n_bytes", "removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(kept_bytes, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def without_repeats(
    docs: DataFrame,
    length: int = 200,
    text_col: str = "text",
    with_text: bool = False,
    carry: list[str] | None = None,
    gram: int = GRAM,
    least_run: int = LEAST_RUN,
) -> DataFrame:
    """Each row with the bytes of its text that a repeated string covers.

    A string of ``length`` UTF-8 bytes is repeated if it also starts elsewhere, in
    another row or in the same one; overlaps count. Adds ``n_bytes``, ``removed``
    (the spans [start, end) that repeated strings cover, ascending and apart),
    ``kept_sha256`` (of the other bytes) and, with ``with_text``, those bytes as
    ``kept``. ``carry`` names the input columns to return, all if not given; added
    columns replace those of their name.

    Defined cases: a null text counts as empty. A text shorter than ``length``
    loses nothing, one that another row equals loses all. Repeated rows count as
    rows. Cuts may lie within a character. An empty table gives an empty table.
    """
    if not 8 <= gram <= length:
        raise ValueError("a sample takes 8 bytes at least and lies within the string")
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    ship(spark)
    carry = docs.columns if carry is None else carry
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(plain, 256)), 1, 16)
    bodies = docs.select(key.alias("key"), plain.cast("binary").alias("body"))
    samples = materialize(
        bodies.where(F.octet_length("body") >= length).mapInArrow(_samples(length, gram), _SAMPLES), "samples"
    )
    taken = samples.where("h IS NOT NULL")
    fair = max(least_run, taken.count() // (RUNS_PER_TASK * parts))
    # at most samples / fair <= RUNS_PER_TASK * parts rows
    hot = (
        taken.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(fair)).cast("int").alias("n_runs"))
        .where("n_runs > 1")
    )
    is_hot = F.col("n_runs").isNotNull()
    dealt = taken.join(F.broadcast(hot), "h", "left").select(
        "h", F.when(is_hot, F.pmod(F.xxhash64("key", "lo"), F.col("n_runs"))).otherwise(0).cast("int").alias("run"),
        is_hot.alias("hot"), "key", "lo", "ahead", "starts",
    )
    shared = (
        dealt.repartition(parts, "h", "run").sortWithinPartitions("h", "run", "key", "lo")
        .mapInArrow(_shared, "h long, run int, hot boolean, key binary, lo long, ahead int, starts int")
    )
    marks = shared.groupBy("key").agg(  # the samples of one text
        F.collect_list(F.struct("h", "run", "hot", "lo", "ahead", "starts")).alias("marks")
    )
    # the texts are dealt once for both uses, as both plans have the filter that joins would add to one
    texts = bodies.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
    near = (
        texts.join(marks, "key").select("key", "copies", "body", "marks").mapInArrow(_near(length), _NEAR)
        .repartition(parts, "h", "run").sortWithinPartitions("h", "run")
    )
    found = near.mapInArrow(_compared(length), _FOUND)
    # strings of dealt samples meet; a span is alone under its own place
    place = F.when(F.col("digest").isNull(), F.struct("start", "end"))
    met = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.coalesce("digest", "key"), place)))
    spans = met.where("digest IS NULL OR (single AND n > 1)").select("key", "start", "end").union(
        samples.where("h IS NULL").select("key", "lo", (F.col("lo") + F.col("starts")).alias("end"))
    )
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    schema = _RESULT + (", kept binary" if with_text else "")
    result = texts.join(spans, "key", "left").select("key", "copies", "body", "spans").mapInArrow(
        _cut(length, with_text), schema
    )
    # rows of a text with very many copies are dealt over runs; at most RUNS_PER_TASK * parts texts are
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"), key.alias("key"))
    fair_rows = max(least_run, docs.count() // (RUNS_PER_TASK * parts))
    often = (
        rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(fair_rows)).cast("int").alias("n_runs"))
        .where("n_runs > 1")
    )
    runs = F.coalesce("n_runs", F.lit(1))
    result = result.join(F.broadcast(often), "key", "left").withColumn("run", F.explode(F.sequence(F.lit(0), runs - 1)))
    rows = rows.join(F.broadcast(often), "key", "left").withColumn(
        "run", F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), runs).cast("int")
    )
    added = ["n_bytes", "removed", "kept_sha256", *(["kept"] if with_text else [])]
    return unpacked(rows.drop("n_runs").join(result.drop("n_runs"), ["key", "run"]), carry, {c: F.col(c) for c in added})
