"""Best-fit packing planned on the histogram of lengths.

Only the counts of each length are packed, longest first, each into the fullest
sequences that still have room. There are at most ``capacity`` lengths, so the
plan is small whatever the number of documents. A plan row says: so many pieces
of this length, so many to a sequence, from this sequence and offset on. Spark
turns the rows into slots numbered within their length, numbers the pieces within
their length and joins both.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import packed, shuffle_parts, ship, unpacked
from visitloom.llm.repetition import blocks
from visitloom.llm.tokens import BLOCK_BYTES, encoder
from visitloom.session import materialize

# Slots that one plan row may spell out inside one task.
SLOTS_PER_ROW = 100_000

_PIECE = pa.struct(
    [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)
_PIECES_DDL = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"


def pieces_udf(path: str, spaced: bool, end_id: int, capacity: int, with_ids: bool):
    @F.arrow_udf(_PIECES_DDL)
    def pieces(texts: pa.Array) -> pa.Array:
        coder, parts = encoder(path, spaced), []
        for block in blocks(texts, BLOCK_BYTES):
            ids, offsets = coder.encode(block, end_id)
            size = np.diff(offsets)
            n = -(-size // capacity)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(size, n) - start)
            raw, at = memoryview(ids.astype("<u4")).cast("B"), np.repeat(offsets[:-1], n) + start
            cut = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
            fields = [
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                pa.array([c.tobytes() for c in cut] if with_ids else pa.nulls(len(cut), pa.binary()), pa.binary()),
            ]
            values = pa.StructArray.from_arrays(fields, fields=list(_PIECE))
            parts.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), values))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_PIECE))

    return pieces


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Rows (length, rank, n, each, sequence, offset): the ``n`` pieces from
    ``rank`` on go ``each`` to a sequence, from ``sequence`` and ``offset`` on.
    """
    out, made = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    free: list[int] = []  # its keys in order

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0

        def fill(first: int, n: int, left: int) -> None:
            """As many as fit into each of up to ``n`` sequences with ``left`` free tokens."""
            nonlocal todo, rank
            each = left // length
            whole = min(n, todo // each)
            if whole:
                out.append((length, rank, whole * each, each, first, capacity - left))
                put(left - each * length, first, whole)
                todo, rank = todo - whole * each, rank + whole * each
            if whole < n and todo:
                out.append((length, rank, todo, todo, first + whole, capacity - left))
                put(left - todo * length, first + whole, 1)
                whole, todo = whole + 1, 0
            put(left, first + whole, n - whole)

        while todo:
            at = bisect_left(free, length)
            if at == len(free):
                n = -(-todo // (capacity // length))
                made, first = made + n, made
                fill(first, n, capacity)
                continue
            left = free[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop(at)
            fill(first, n, left)
    return out


def _slots(spark, rows: list[tuple], parts: int) -> DataFrame:
    """(length, rank, sequence_id, offset), one row for each planned slot."""
    schema = "length long, first_rank long, n long, each long, first_sequence long, first_offset long"
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS_PER_ROW).cast("long")))
    last = F.least(F.col("from") + SLOTS_PER_ROW, "n") - 1
    i = F.explode(F.sequence("from", last))
    return (
        spark.createDataFrame(rows, schema)
        .withColumn("from", chunk)
        .repartition(parts)
        .withColumn("i", i)
        .select(
            "length",
            (F.col("first_rank") + F.col("i")).alias("rank"),
            F.expr("first_sequence + i div each").alias("sequence_id"),
            (F.col("first_offset") + F.col("i") % F.col("each") * F.col("length")).alias("offset"),
        )
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    spaced: bool,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    with_ids: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """A row for each piece of a document with its place in a packed sequence.

    Adds ``piece``, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32``, ``ids`` (little-endian, with ``with_ids``), ``sequence_id``
    and ``offset``. ``tokenizer`` is a tokenizer file that every executor can
    read; ``end_id`` closes each document. Only documents over ``capacity`` ids
    are cut, into pieces of ``capacity`` and a rest. Offsets in a sequence are
    gapless from 0.

    Defined cases: a null or empty text is just the end id. Null and repeated
    ids and repeated rows each have their own pieces. An empty table gives an
    empty table. ``carry`` names the input columns to return, all if not given;
    added columns replace those of their name.
    """
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    ship(spark)
    carry = docs.columns if carry is None else carry
    cut = docs.select(
        packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
        F.col(id_col).alias("id"),
        F.explode(pieces_udf(tokenizer, spaced, end_id, capacity, with_ids)(F.col(text_col))).alias("p"),
    )
    pieces = materialize(
        cut.select("row", "id", "p.*").withColumn("at", F.monotonically_increasing_id()), "pieces"
    )
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return unpacked(
            pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")),
            carry, {c: F.col(c) for c in _added(with_ids)},
        )
    # a common length is numbered in several runs: at most 2 * parts more runs than lengths
    fair = max(64, total // (2 * parts))
    runs = spark.createDataFrame([(k, -(-n // fair)) for k, n in counts.items()], "of long, n_runs long")
    dealt = pieces.join(F.broadcast(runs), F.col("length") == F.col("of")).withColumn(
        "run", F.pmod(F.xxhash64("id", "piece", "at"), F.col("n_runs"))
    )
    cells = dealt.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        F.col("length").alias("of_length"), F.col("run").alias("of_run"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
    )
    in_run = F.row_number().over(Window.partitionBy("length", "run").orderBy("id", "piece", "at")) - 1
    ranked = (
        dealt.withColumn("in_run", in_run)
        .join(F.broadcast(starts), (F.col("length") == F.col("of_length")) & (F.col("run") == F.col("of_run")))
        .withColumn("rank", F.col("base") + F.col("in_run"))
        .select("row", "piece", "start", "length", "ids_crc32", "ids", "rank")
    )
    slots = _slots(spark, plan(counts, capacity), parts)
    placed = ranked.join(slots, ["length", "rank"])
    return unpacked(placed, carry, {c: F.col(c) for c in _added(with_ids)})


def _added(with_ids: bool) -> list[str]:
    ids = ["ids"] if with_ids else []
    return ["piece", "start", "length", "ids_crc32", *ids, "sequence_id", "offset"]
