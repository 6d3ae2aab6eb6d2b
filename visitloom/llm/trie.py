"""Prefix tries of conversations as balanced parentheses.

A node is a distinct sequence of first turns. Distinct whole sequences are dealt
over ranges and sorted, so that a shard, a run of neighbours, holds a piece of the
trie in preorder: a parenthesis opens where a turn is new and closes behind the
node's subtree. A range min-max tree over blocks of the excess finds the closing
one; ranks of opening parentheses and of leaf pairs, and cumulative arrays over the
nodes between the two, give a node's members, leaves and savings.

Only nodes on the paths of a shard's first and last sequence, its spines, may occur
in other shards. Their sums add up over shards, save for the spine nodes below
them, which several shards see: each of these is owned by one path, and sums along
the paths, from the end up, count it once for each node above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import WORD, shuffle_parts, ship
from visitloom.session import materialize

# Turns of distinct sequences in a shard, about; one sequence at least.
SHARD_TURNS = 200_000
# Parentheses in a block of the min-max tree.
BLOCK = 64
# Bytes that name a turn within a sequence.
TURN = 16
# Bytes of listed ids that are hashed at once.
LIST_BYTES = 1_000_000

TURNS = "array<struct<name:binary,words:int>>"
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SHARD = (
    "spine boolean, shard long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "words long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, on_left boolean, on_right boolean"
)


class Parentheses:
    """Balanced parentheses, +1 and -1, with a min-max tree of the excess."""

    def __init__(self, signs: np.ndarray):
        self.excess = np.cumsum(signs, dtype=np.int64)
        n_blocks = max(1, -(-len(signs) // BLOCK))
        padded = np.full(n_blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(signs)] = self.excess
        self.blocks = padded.reshape(n_blocks, BLOCK)
        self.opens = np.flatnonzero(signs > 0)
        self.open_rank = np.cumsum(signs > 0)
        leaf = (signs > 0) & (np.r_[signs[1:], 1] < 0)
        self.leaf_rank = np.cumsum(leaf)
        # least excess below each vertex, level by level; each level is padded to even length
        self.levels = [self.blocks.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = self.levels[-1] = np.r_[low, np.iinfo(np.int64).max]
            self.levels.append(np.minimum(low[::2], low[1::2]))

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in the block behind ``after`` with at most the target; -1 if none."""
        hit = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > after[:, None])
        first = hit.argmax(axis=1)
        return np.where(hit[np.arange(len(block)), first], block * BLOCK + first, -1)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those at ``at``."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 10_000):
            out[i : i + 10_000] = self._findclose(at[i : i + 10_000])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        found = self._in_block(at // BLOCK, at % BLOCK, target)
        far = np.flatnonzero(found < 0)
        vertex, level = at[far] // BLOCK + 1, np.zeros(len(far), np.int64)
        goal, down = target[far], np.zeros(len(far), bool)
        for _ in range(2 * len(self.levels) + 2):
            for h in range(len(self.levels)):  # up: to the next vertex that holds the target
                up = np.flatnonzero(~down & (level == h))
                if not len(up):
                    continue
                here = vertex[up] < len(self.levels[h])
                holds = np.zeros(len(up), bool)
                holds[here] = self.levels[h][vertex[up][here]] <= goal[up[here]]
                down[up[holds]] = True
                rest = up[~holds]
                odd = vertex[rest] % 2 == 1  # the last of its parent: go on behind the parent
                vertex[rest] = np.where(odd, (vertex[rest] + 1) // 2, vertex[rest] + 1)
                level[rest[odd]] += 1
            if down.all():
                break
        for h in range(len(self.levels) - 1, 0, -1):  # down: to the leftmost block that holds it
            of = np.flatnonzero(level == h)
            left = 2 * vertex[of]
            vertex[of] = np.where(self.levels[h - 1][left] <= goal[of], left, left + 1)
            level[of] = h - 1
        found[far] = self._in_block(vertex, np.full(len(far), -1), goal)
        return found


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each range, from the least of runs of powers of two."""
    size = end - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, runs, h = np.empty(len(start), values.dtype), values, 0
    while True:
        of = np.flatnonzero(level == h)
        out[of] = np.minimum(runs[start[of]], runs[end[of] - (1 << h)])
        if h >= level.max():
            return out
        runs = np.minimum(runs[: -(1 << h)], runs[1 << h :])
        h += 1


def _shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN] == b[: mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def _shard(shard: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_SHARD`` of sorted distinct sequences (key, words, n, least id, ends)."""
    depth = np.array([len(r[0]) // TURN for r in rows])
    shared = np.array([-1] + [_shared_turns(a[0], b[0]) for a, b in zip(rows, rows[1:])])
    # close what isn't shared with the sequence before, open the rest; the first opens the root too
    turns = np.empty(2 * len(rows) + 1, np.int64)
    turns[0], turns[2:-1:2] = 0, depth[:-1] - shared[1:]
    turns[1::2], turns[-1] = depth - shared, depth[-1] + 1
    signs = np.repeat(np.r_[np.tile([-1, 1], len(rows)), -1], turns)
    tree = Parentheses(signs)
    n = len(tree.opens)
    made = depth - shared  # nodes that a sequence adds, in preorder
    first = np.cumsum(made) - made
    words, parent, path = np.zeros(n, np.int64), np.arange(-1, n - 1), []
    end_of = np.empty(len(rows), np.int64)
    for i, row in enumerate(rows):
        if i:
            if made[i]:
                parent[first[i]] = path[shared[i]]
            del path[shared[i] + 1 :]
        path.extend(range(first[i], first[i] + made[i]))
        new = depth[i] - max(0, shared[i])  # the root has no words
        if new:
            words[first[i] + made[i] - new : first[i] + made[i]] = row[1][-new:]
        end_of[i] = path[depth[i]]
    ends = np.zeros(n, np.int64)
    ends[end_of] = [r[2] for r in rows]
    least = np.full(n, np.iinfo(np.int64).max)
    least[end_of] = [r[3] for r in rows]
    listed = np.full(n, None, object)
    listed[end_of] = [r[4] for r in rows]

    close = tree.findclose(tree.opens)
    after = tree.open_rank[close]  # the subtree's nodes are those from its own place to here

    def below(values: np.ndarray) -> np.ndarray:
        done = np.r_[0, np.cumsum(values)]
        return done[after] - done[np.arange(n)]

    spine = np.zeros(n, bool)
    left, right = np.arange(depth[0] + 1), np.array(path)
    spine[left], spine[right] = True, True
    n_convs, conv = below(ends), _least(least, np.arange(n), after)
    n_leaves = tree.leaf_rank[close] - tree.leaf_rank[tree.opens] + (close == tree.opens + 1)
    is_leaf = (close == tree.opens + 1).astype(np.int64)
    saved = np.where(spine, 0, (n_convs - 1) * words)
    n_children = np.bincount(parent[1:][~spine[1:]], minlength=n)
    n_leaves = np.where(spine, below(np.where(spine, 0, is_leaf)), n_leaves)
    name = np.full(n, None, object)
    for nodes, key in ((left, rows[0][0]), (right, rows[-1][0])):
        for d, node in enumerate(nodes):
            name[node] = hashlib.blake2b(key[: d * TURN], digest_size=TURN).digest()
    under_spine = (parent >= 0) & spine[parent]
    above = np.where(parent >= 0, parent, 0)
    on_left, on_right = np.zeros(n, bool), np.zeros(n, bool)
    on_left[left], on_right[right] = True, True
    columns = [
        pa.array(spine), pa.array(np.full(n, shard)),
        pa.array(name, pa.binary()),
        pa.array(np.where(under_spine, name[above], None), pa.binary()),
        pa.array(tree.excess[tree.opens] - 1), pa.array(conv),
        pa.array(conv[above], mask=under_spine | (parent < 0)),
        pa.array(words), pa.array(n_convs), pa.array(n_children), pa.array(n_leaves),
        pa.array(below(saved)), pa.array(listed, pa.binary()), pa.array(on_left), pa.array(on_right),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SHARD.split(", ")])


def _shards(most_turns: int):
    """Arrow function over sorted distinct sequences: the rows of their shards."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, shard = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and turns + len(row[1]) > most_turns:
                    yield _shard(shard, held)
                    held, turns, shard = [], 0, shard + 1
                held.append(row)
                turns += len(row[1])
        if held:
            yield _shard(shard, held)

    return shards


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids, comma-joined, of rows (sequence, id) sorted by both."""
    sequence, ids, size = None, [], 0

    def run() -> pa.RecordBatch:
        columns = [pa.array([sequence], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(columns, ["of", "first_id", "ids"])

    for batch in batches:
        for of, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (of != sequence or size > LIST_BYTES):
                yield run()
                ids, size = [], 0
            sequence = of
            ids.append(own)
            size += 8
    if ids:
        yield run()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all runs of a sequence, of rows sorted by (sequence, first id)."""
    sequence, state, done = None, None, []
    for batch in batches:
        for of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if of == sequence:
                state.update(b",")
            else:
                if state is not None:
                    done.append((sequence, state.digest()))
                sequence, state = of, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done)], ["of", "ends"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sequence], pa.binary()), pa.array([state.digest()], pa.binary())], ["of", "ends"])


def turn_struct(role, text):
    """What the trie keeps of a turn: a digest of role and text, and the words of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    name = F.substring(F.unhex(F.sha2(whole, 256)), 1, TURN)
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0))
    return F.struct(name.alias("name"), words.alias("words"))


def numbered_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id``, ``n`` from 0 and ``turn`` (as ``turn_struct``) of each row.

    In order of turn, null first; ties in order of role, then text. Rows without a
    conversation id are left out, as they belong to no conversation.
    """
    plain = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return plain.select(
        "conv_id", (F.row_number().over(order) - 1).alias("n"), turn_struct(F.col("role"), F.col("text")).alias("turn")
    )


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turns_col: str = "turns", shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """A row for each distinct sequence of first turns, from the empty one on.

    ``turns_col`` holds a conversation's turns in order, as ``turn_struct`` makes
    them. Columns: ``conv_id`` (the smallest member's), ``depth``, ``parent_conv_id``
    (null at the root), ``n_convs`` (members: conversations that begin so),
    ``n_children``, ``n_leaves`` (nodes without children in the subtree, itself
    included), ``saved_tokens`` (over the subtree, all members but one times the
    words of the last turn) and ``ends_sha256`` (SHA-256 of the ids of the members
    that end there, ascending, comma-joined). A shard holds about ``shard_turns``
    turns of distinct sequences, one sequence at least.

    Defined cases: null turns are none, and such a conversation is a member of the
    root only. A row with a null id is left out. Each row is a conversation, also
    where ids repeat. An empty table gives an empty table. Other columns are not read.
    """
    spark, parts = conversations.sparkSession, shuffle_parts(conversations.sparkSession)
    ship(spark)
    turns = F.coalesce(F.col(turns_col), F.array().cast(TURNS))
    rows = materialize(
        conversations.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("conv_id"),
            F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["name"])), "")).alias("key"),
            F.transform(turns, lambda t: t["words"]).alias("words"),
        ),
        "sequences",
    )
    of = F.substring(F.unhex(F.sha2("key", 256)), 1, 2 * TURN).alias("of")
    # one hash has to read one list in order; its runs are made side by side
    runs = (
        rows.select(of, "conv_id")
        .repartitionByRange(parts, "of", "conv_id").sortWithinPartitions("of", "conv_id")
        .mapInArrow(_listed, "of binary, first_id long, ids string")
    )
    ends = (
        runs.repartition(parts, "of").sortWithinPartitions("of", "first_id")
        .mapInArrow(_hashed, "of binary, ends binary")
    )
    distinct = (
        rows.groupBy("key")
        .agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
        .withColumn("of", of)
        .join(ends, "of")
        .select("key", "words", "n", "least", "ends")
    )
    shards = (
        materialize(distinct, "distinct")
        .repartitionByRange(parts, "key").sortWithinPartitions("key")
        .mapInArrow(_shards(shard_turns), _SHARD)
    )
    shards = materialize(shards, "shards")

    side = F.explode(F.filter(
        F.array(F.when(F.col("on_left"), F.lit(0)), F.when(F.col("on_right"), F.lit(1))), lambda s: s.isNotNull()
    )).alias("side")
    spine = shards.where("spine")
    own_path = F.struct("shard", F.when(F.col("on_left"), F.lit(0)).otherwise(1).alias("side"))
    merged = spine.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.min(own_path).alias("owner"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    spine_children = merged.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_spine"))
    merged = materialize(
        merged.join(spine_children, "node", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("n_spine", F.lit(0)))
        .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("own_leaf", (F.col("n_children") == 0).cast("long"))
        .drop("n_spine"),
        "spines",
    )
    paths = spine.select("shard", side, "node").join(
        merged.select("node", "depth", "owner", "own_saved", "own_leaf"), "node"
    )
    up = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))  # one path
    owned = (F.col("owner.shard") == F.col("shard")) & (F.col("owner.side") == F.col("side"))

    def so_far(c: str):
        return F.sum(F.when(owned, F.col(c)).otherwise(0)).over(up).alias(c)

    met = paths.select("node", so_far("own_saved"), so_far("own_leaf")).groupBy("node").agg(
        F.sum("own_saved").alias("met_saved"), F.sum("own_leaf").alias("met_leaves")
    )
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    spines = (
        merged.join(met, "node").join(names, "parent", "left")
        .withColumn("n_leaves", F.col("n_leaves") + F.col("met_leaves"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.col("met_saved"))
    )
    # a shard asks for its own spine, so that no key has more rows than a shard
    of_shard = spine.select("shard", F.col("node").alias("parent")).join(names, "parent")
    inner = shards.where("NOT spine").join(of_shard, ["shard", "parent"], "left").withColumn(
        "above", F.coalesce("parent_conv_id", "above")
    )
    columns = ["conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shown = F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256")
    return spines.select(*columns, shown).union(inner.select(*columns, shown))
