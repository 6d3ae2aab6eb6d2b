"""Token ids in 64-bit words: Simple-8b with escapes and block offsets.

The top four bits of a word select how many ids it packs and how wide they are.
An id too wide for the widest selector is escaped: its word holds a place in a
table of whole ids. Ids are coded in blocks of a fixed number of ids, each of
which starts a new word; the word offset of every block is stored, so blocks are
coded and decoded side by side and a reader may begin at any of them.

A payload, all little-endian: magic ``S8B1``, ids per block (u4), ids (u8),
documents (u8), blocks (u8), words (u8), escapes (u8); then document lengths
(u8), the words at which blocks begin (u8), words (u8) and escapes (u8).

A file is one partition of a Parquet table, so that it can lie in any store that
Spark reaches. Its rows hold one payload each, whole documents in ascending order
of id, and the number of ids before it in the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import shuffle_parts, ship
from visitloom.llm.repetition import blocks
from visitloom.llm.tokens import encoder

MAGIC = b"S8B1"
BLOCK_IDS = 256
# Bytes of text whose ids make one row of a file.
BLOCK_BYTES = 8_000_000
_HEADER = struct.Struct("<4sIQQQQQ")
# Fixed values of the format: ids in a word and bits of each, by selector.
# Selector 0 is the escape.
SELECTORS = ((1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([c for c, _ in SELECTORS] + [0])
_U8 = np.dtype("<u8")


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int8)


def encode(ids: np.ndarray, lengths: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Payload of the ids of documents with these lengths."""
    ids = ids.astype(np.uint64)
    n, widest = len(ids), max(c for c, _ in SELECTORS)
    n_blocks = -(-n // block_ids)
    # bits of each id, a row for each block; beyond a block's end nothing fits
    bits = np.full((n_blocks, block_ids + widest), 127, np.int8)
    own = np.full(n_blocks * block_ids, 127, np.int8)
    own[:n] = _bit_lengths(ids)
    bits[:, :block_ids] = own.reshape(n_blocks, block_ids)
    most = bits[:, :block_ids].copy()  # bits of the widest of the next ``count`` ids
    choice = np.zeros(most.shape, np.int8)  # escape, unless something fits
    count = 1
    for s in range(len(SELECTORS) - 1, 0, -1):  # the last that fits packs the most
        while count < SELECTORS[s][0]:
            np.maximum(most, bits[:, count : count + block_ids], out=most)
            count += 1
        choice[most <= SELECTORS[s][1]] = s
    choice = choice.ravel()
    step = _COUNTS[choice]
    block_end = np.minimum(np.arange(1, n_blocks + 1) * block_ids, n)
    starts = []
    here = np.arange(0, n, block_ids)  # all blocks go forward side by side
    while len(here):
        starts.append(here)
        after = here + step[here]
        more = after < block_end
        here, block_end = after[more], block_end[more]
    first = np.sort(np.concatenate(starts)) if starts else np.empty(0, np.int64)
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(SELECTORS)):
        count, bits = SELECTORS[s]
        of = np.flatnonzero(chosen == s)
        if len(of):
            shift = (np.arange(count) * bits).astype(np.uint64)
            words[of] |= np.bitwise_or.reduce(ids[first[of][:, None] + np.arange(count)] << shift, axis=1)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    escapes = ids[first[escaped]]
    block_starts = np.searchsorted(first, np.arange(0, n, block_ids))
    head = _HEADER.pack(MAGIC, block_ids, n, len(lengths), len(block_starts), len(words), len(escapes))
    return head + b"".join(x.astype(_U8).tobytes() for x in (lengths, block_starts, words, escapes))


def read(payload: bytes) -> tuple[int, int, list[np.ndarray]]:
    """Ids per block, ids, and the arrays lengths, block starts, words and escapes."""
    magic, block_ids, n, *sizes = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    arrays, at = [], _HEADER.size
    for size in sizes:
        arrays.append(np.frombuffer(payload, _U8, size, at))
        at += 8 * size
    return block_ids, n, arrays


def decode(payload: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``end``; only the blocks that hold them are decoded."""
    block_ids, n, (_, block_starts, words, escapes) = read(payload)
    end = n if end is None else min(end, n)
    if start >= end:
        return np.empty(0, np.uint64)
    first, last = start // block_ids, -(-end // block_ids)
    a = int(block_starts[first])
    b = int(block_starts[last]) if last < len(block_starts) else len(words)
    words = words[a:b]
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        of = np.flatnonzero(chosen == s)
        if not len(of):
            continue
        shift = (np.arange(count) * bits).astype(np.uint64)
        values = (words[of][:, None] >> shift) & np.uint64((1 << bits) - 1)
        out[place[of][:, None] + np.arange(count)] = values if s else escapes[values.astype(np.int64)]
    skip = start - first * block_ids
    return out[skip : skip + end - start]


_FILE_ROWS = "file int, row int, first_id long, n_ids long, doc_ids array<long>, payload binary"


def _rows(path: str, spaced: bool, end_id: int):
    """Arrow function over sorted (doc_id, text): the rows of a file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, row, first = encoder(path, spaced), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1), BLOCK_BYTES):
                ids, offsets = coder.encode(block, end_id)
                own = batch.column(0).slice(at, len(block))
                at += len(block)
                columns = [
                    pa.array([file], pa.int32()),
                    pa.array([row], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    pa.array([encode(ids, np.diff(offsets))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row", "first_id", "n_ids", "doc_ids", "payload"])
                row, first = row + 1, first + len(ids)

    return rows


def write(
    docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the ids of all documents to ``folder``, files and rows in ascending order of id.

    Defined cases: a null or empty text is just the end id. Null ids come first;
    rows with the same id lie in order of their texts and stay separate. An empty
    table makes a folder without rows. Other columns are not written.
    """
    ship(docs.sparkSession)
    ids = F.col(id_col).cast("long").alias("doc_id")
    (
        docs.select(ids, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
        .repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(_rows(tokenizer, spaced, end_id), _FILE_ROWS)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, _, first, _, doc_ids, payload = batch.columns
        for i in range(batch.num_rows):
            raw = payload[i].as_py()
            lengths = read(raw)[2][0].astype(np.int64)
            ids = memoryview(decode(raw).astype("<u4")).cast("B")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(lengths)
            columns = [
                doc_ids[i].values,
                pa.array(np.full(n, file[i].as_py(), np.int32)),
                pa.array(starts + first[i].as_py()),
                pa.array(lengths),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "in_file", "n_tokens", "ids_crc32"])


def documents(spark, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""
    ship(spark)
    stored = spark.read.schema(_FILE_ROWS).parquet(folder)
    sizes = stored.groupBy("file").agg(F.sum("n_ids").alias("n"))
    # one row for each file: as many as the writer had partitions
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = stored.mapInArrow(
        _documents, "doc_id long, file int, in_file long, n_tokens long, ids_crc32 long"
    )
    return found.join(F.broadcast(offsets), F.col("file") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
