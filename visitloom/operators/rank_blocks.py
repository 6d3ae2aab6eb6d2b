"""Average ranks of all columns of visits that lie in blocks, as numpy arrays.

A block is a batch of visits in a task. It cuts its values of a column at splitters and
sends, of each stretch between two of them, the distinct values and their counts; the
pieces of a stretch meet, and their ranks go back to the blocks. What moves is a few long
rows, a task holds one stretch or one block, and equal values of a block move once. The
splitters come from a sample and decide balance only, never a rank.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.session import materialize

# Tasks carry this module's helpers with them, so workers need not import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a column that one stretch should have.
STRETCH = 500_000
# Visits that are sampled for a splitter.
SAMPLED = 10_000

_PIECES = "block long, pos int, stretch int, n long, below long, zero long, row binary, val binary, size binary"


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each column its known values in order, and the rows they are in."""
    lists, val = batch.column(0), batch.column(1).flatten()
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    known = np.asarray(val.is_valid().cast(pa.int8())) == 1
    row, pos, val = row[known], np.asarray(lists.flatten())[known], val.to_numpy(zero_copy_only=False)[known]
    order = np.lexsort((val, pos))
    row, pos, val = row[order], pos[order], val[order] + 0.0  # no negative zero
    edges = np.flatnonzero(np.diff(pos, prepend=-1, append=-1)) if len(pos) else []
    for start, end in zip(edges[:-1], edges[1:]):
        yield int(pos[start]), row[start:end], val[start:end]


def _splitters(lists: DataFrame, n: int, stretches: int) -> dict[int, np.ndarray]:
    """Values that cut a column into about as many stretches, from a sample of the ``n`` lists."""
    if stretches < 2:
        return {}
    some = lists.sample(min(1.0, SAMPLED * stretches / n), seed=1) if n else lists
    values = some.select(F.inline(F.arrays_zip("pos", "val"))).groupBy("pos")
    shares = [i / stretches for i in range(1, stretches)]
    cuts = values.agg(F.percentile_approx("val", shares).alias("cuts")).where("cuts is not null")
    return {r["pos"]: np.unique(r["cuts"]) for r in cuts.collect()}


def _cut(splitters: dict[int, np.ndarray]):
    """Arrow function from lists to the pieces of their blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            block, pieces = (TaskContext.get().partitionId() << 32) + k, []
            for pos, row, val in _columns(batch):
                bounds = [0, *np.searchsorted(val, splitters.get(pos, []), "right"), len(val)]
                for stretch, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    if i < j:
                        distinct, size = np.unique(val[i:j], return_counts=True)
                        below, to_zero = np.searchsorted(val[i:j], 0.0), np.searchsorted(val[i:j], 0.0, "right")
                        counts = (j - i, below, to_zero - below)
                        arrays = (row[i:j], distinct, size.astype(np.int32))
                        pieces.append((block, pos, stretch, *map(int, counts), *(x.tobytes() for x in arrays)))
            if pieces:
                types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3]
                columns = [pa.array(x, t) for x, t in zip(zip(*pieces), types)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])

    return cut


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _ranker(shift: dict[tuple[int, int], float], absent: dict[int, int]):
    """Arrow function over the pieces of a stretch: the rank of each piece's distinct values, from zero's."""

    def ranked(pieces: pa.Table) -> pa.Table:
        pos, stretch = pieces["pos"][0].as_py(), pieces["stretch"][0].as_py()
        vals, sizes = _arrays(pieces["val"], np.float64), _arrays(pieces["size"], np.int32)
        distinct, at = np.unique(np.concatenate(vals), return_inverse=True)
        n = np.bincount(at, np.concatenate(sizes))
        u = np.cumsum(n) - n + (n + 1) / 2 + shift[pos, stretch] + np.where(distinct < 0, 0, absent[pos])
        u = np.where(distinct == 0, 0.0, u)[at]
        parts = np.split(u, np.cumsum([len(v) for v in vals])[:-1])
        columns = [pieces["block"], pieces["pos"], pieces["stretch"], pa.array([x.tobytes() for x in parts], pa.binary())]
        return pa.table(columns, ["block", "pos", "stretch", "u"])

    return ranked


def _back(pieces: pa.Table, ranks: pa.Table) -> pa.Table:
    """One row for a block: row, column and rank of each of its values."""
    order = [("pos", "ascending"), ("stretch", "ascending")]
    pieces, ranks = pieces.sort_by(order), ranks.sort_by(order)
    rows, sizes = _arrays(pieces["row"], np.int32), _arrays(pieces["size"], np.int32)
    u = np.repeat(np.concatenate(_arrays(ranks["u"], np.float64)), np.concatenate(sizes))
    pos = np.repeat(np.asarray(pieces["pos"]), [len(x) for x in rows])
    return pa.table({"row": [np.concatenate(rows).tobytes()], "pos": [pos.tobytes()], "u": [u.tobytes()]})


def ranks(lists: DataFrame, n: int, have: dict[int, int], stretch_rows: int = STRETCH) -> DataFrame:
    """(row, pos, u): of each block of visits the rows, columns and ranks of their known values, as bytes.

    ``lists`` are (pos, val) lists from a table; ``n`` says how many visits there are,
    and ``have`` in how many of them a column is present, known or not. u is the average
    rank less that of a zero, which is what absent columns have. Rows count from 0 in
    their block. The numbers on the driver are as many as columns and stretches.
    """
    lists = lists.select("pos", "val")
    splitters = _splitters(lists, n, -(-max(have.values(), default=0) // stretch_rows))
    pieces = materialize(lists.mapInArrow(_cut(splitters), _PIECES), "pieces")
    totals = pieces.groupBy("pos", "stretch").agg(*[F.sum(c).alias(c) for c in ("n", "below", "zero")])
    absent = {pos: n - rows for pos, rows in have.items()}
    below, zero, before = ({p: 0 for p in have} for _ in range(3))
    shift = {}
    found = totals.orderBy("pos", "stretch").collect()
    for r in found:
        below[r["pos"]] += r["below"]
        zero[r["pos"]] += r["zero"]
    for r in found:
        p = r["pos"]
        shift[p, r["stretch"]] = before[p] - below[p] - (absent[p] + zero[p] + 1) / 2
        before[p] += r["n"]
    ranked = (
        pieces.select("block", "pos", "stretch", "val", "size")
        .groupBy("pos", "stretch")
        .applyInArrow(_ranker(shift, absent), "block long, pos int, stretch int, u binary")
    )
    own = pieces.select("block", "pos", "stretch", "row", "size").groupBy("block")
    return own.cogroup(ranked.groupBy("block")).applyInArrow(_back, "row binary, pos binary, u binary")
