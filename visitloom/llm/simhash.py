"""SimHash near-duplicates, found by pigeonring filtering.

The 64 bits are cut into segments on a ring. If two fingerprints differ in at
most ``d`` bits, some chain of consecutive segments around the ring keeps every
prefix of ``l`` segments within ``l * d / segments`` differences. The first
segments of such a chain have a budget below one and so are equal: they are the
key under which candidates meet. Longer prefixes prune candidates before the
full Hamming check.

Fingerprints that meet under one key are compared inside a task, which returns
only a spanning set of links. A key with more fingerprints than a task compares
is left to a second, also exact way of linear size: two fingerprints within
``d`` bits share a neighbour within half of that, so each one is filed under its
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import one_row_of, packed, row_digest, rows_without, ship, shuffle_parts, unpacked
from visitloom.llm.components import connected
from visitloom.session import materialize

SEGMENTS = 5
# Fingerprints of one key that are compared pair by pair inside a task.
PAIRWISE = 2048
_BLOCK = 256


def _fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        pieces = [line]
    else:
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *[e + 1 for e in ends[:-1]]]
        pieces = [line[s:e] for s, e in zip(starts, ends[shingle - 1 :])]
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.dtype("<u8"), len(pieces)
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.dtype("<i8"))[0])


def fingerprint_udf(shingle: int, seed: int):
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts.cast(pa.binary())):
            out[i] = _fingerprint(text.as_py(), shingle, seed)
        return pa.array(out)

    return fingerprints


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(distance: int, segments: int = SEGMENTS) -> tuple[list[list[int]], int]:
    """Masks of the chains by start and length (from 1), and the length of the equal part."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(segments)]
    chains = [
        list(accumulate((masks[(i + j) % segments] for j in range(segments)), lambda x, y: x | y))
        for i in range(segments)
    ]
    return chains, segments if distance == 0 else min(segments, (segments - 1) // distance)


def _linked(x: np.ndarray, chains: np.ndarray, budgets: list[int], distance: int) -> np.ndarray:
    """Where the differences ``x`` stay within the chain's budgets and the distance."""
    ok = np.ones(x.shape, bool)
    for i, budget in enumerate(budgets):
        ok &= np.bitwise_count(x & chains[..., i]) <= budget
    ok[ok] = np.bitwise_count(x[ok]) <= distance
    return ok


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the links a-b."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if np.array_equal(before, labels):
            break
    return labels


def _large_group(fps: np.ndarray, chains: np.ndarray, budgets: list[int], distance: int) -> np.ndarray:
    labels = np.arange(len(fps))
    while True:
        new = labels.copy()
        for s in range(0, len(fps), _BLOCK):
            ok = _linked(fps[s : s + _BLOCK, None] ^ fps[None, :], chains, budgets, distance)
            new[s : s + _BLOCK] = np.where(ok, labels[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, labels)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _spanning(slot: np.ndarray, key: np.ndarray, fp: np.ndarray, masks, budgets, distance):
    """Links that connect what is linked under each key; rows are sorted by slot and key."""
    n = len(fp)
    new = np.r_[True, (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows after it in its group
    labels = np.arange(n)
    for s, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        part = fp[s : s + size]
        labels[s : s + size] = s + _large_group(part, masks[slot[s]], budgets, distance)
    left[np.repeat(sizes > 64, sizes)] = 0
    pairs_a, pairs_b = [], []
    at = np.flatnonzero(left > 0)
    step = 1
    while len(at):
        ok = _linked(fp[at] ^ fp[at + step], masks[slot[at]], budgets, distance)
        pairs_a.append(at[ok])
        pairs_b.append(at[ok] + step)
        step += 1
        at = at[left[at] >= step]
    if pairs_a:
        labels = _settle(labels, np.concatenate(pairs_a), np.concatenate(pairs_b))
    linked = np.flatnonzero(labels != np.arange(n))
    return fp[linked], fp[labels[linked]]


def _bucket_links(distance: int, segments: int):
    """Arrow function over rows sorted by slot and key: links (a, b) of each key."""
    chains, equal = ring(distance, segments)
    # of prefixes with the same budget the longest says all
    budgets = {l * distance // segments: l for l in range(equal + 1, segments)}
    masks = np.array([[c[l - 1] for l in budgets.values()] for c in chains], np.uint64)
    masks = masks.reshape(segments, len(budgets))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def result(slot, key, fp):
            a, b = _spanning(slot, key, fp, masks, list(budgets), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            columns[2] = columns[2].view(np.uint64)
            held = [np.concatenate(pair) for pair in zip(held, columns)]
            slot, key, _ = held
            same = (slot == slot[-1]) & (key == key[-1]) if len(slot) else np.empty(0, bool)
            cut = len(same) - int(same.sum())
            if cut:
                yield result(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if len(held[0]):
            yield result(*held)

    return links


def _shared_neighbours(fps: DataFrame, distance: int) -> DataFrame:
    """Links among ``fps`` through a fingerprint between both; exact, and linear in the rows.

    At most 65 (distance to 2) or 2081 (to 4) fingerprints are filed under one.
    """
    far, near = (distance + 1) // 2, distance // 2
    flips = [
        F.struct(F.lit(_signed(sum(1 << i for i in c))).alias("bits"), F.lit(r).alias("r"))
        for r in range(far + 1)
        for c in combinations(range(64), r)
    ]
    filed = fps.select("fp", F.explode(F.array(*flips)).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip.bits")).alias("hub"), "fp", F.col("flip.r").alias("r")
    )
    return (
        filed.groupBy("hub")
        .agg(F.collect_set("fp").alias("members"), F.min(F.when(F.col("r") <= near, F.col("fp"))).alias("b"))
        .where("b IS NOT NULL AND size(members) > 1")
        .select(F.explode("members").alias("a"), "b")
        .where("a != b")
    )


def links(fps: DataFrame, distance: int, segments: int = SEGMENTS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b) among distinct fingerprints ``fp``: enough links to connect all within ``distance``."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be from 0 to 4")
    ship(fps.sparkSession)
    parts = shuffle_parts(fps.sparkSession)
    chains, equal = ring(distance, segments)
    keys = fps.select(
        "fp",
        F.posexplode(
            F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(c[equal - 1]))) for c in chains])
        ).alias("slot", "key"),
    )
    shared = keys.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keys.join(shared, ["slot", "key"]), "met")
    compared = (
        met.where(F.col("n") <= pairwise)
        .select("slot", "key", "fp")
        .repartition(parts, "slot", "key")
        .sortWithinPartitions("slot", "key", "fp")
        .mapInArrow(_bucket_links(distance, segments), "a long, b long")
    )
    crowded = met.where(F.col("n") > pairwise).select("fp").distinct()
    return compared.union(_shared_neighbours(crowded, distance))


def _classes(rows: DataFrame, distance: int, segments: int, pairwise: int) -> DataFrame:
    """``fp`` and ``first``, the smallest ``order`` of its component, for rows (fp, order)."""
    fps = materialize(rows.groupBy("fp").agg(F.min("order").alias("least")), "fingerprints")
    tree = connected(links(fps.select("fp"), distance, segments, pairwise))
    tree = materialize(
        tree.union(tree.select("root", "root").distinct()).join(fps, F.col("node") == F.col("fp")), "tree"
    )
    first = tree.groupBy("root").agg(F.min("least").alias("first"))
    found = tree.join(first, "root").select(F.col("fp").alias("of"), "first")
    return fps.join(found, F.col("fp") == F.col("of"), "left").select(
        "fp", F.coalesce("first", "least").alias("first")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    seed: int = 42,
    segments: int = SEGMENTS,
    pairwise: int = PAIRWISE,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row with ``fingerprint`` (16 hex digits) and ``component_id``.

    A fingerprint has the bits that are set in over half of the XXH64 hashes of
    the text's shingles of ``shingle`` words, repeats included. Fingerprints
    within ``distance`` bits link; ``component_id`` is the smallest id reachable.

    Defined cases: a text of fewer words is one shingle; a null, empty or blank
    text has fingerprint zero, which links like any other. Null ids come after
    all others, a component of null ids has a null ``component_id``. Repeated
    ids and rows each keep their row. An empty table gives an empty table.
    ``carry`` names the input columns to return, all if not given; added columns
    replace those of their name.
    """
    ship(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rows = materialize(
        docs.select(
            packed(docs.select(*[f"`{c}`" for c in carry])).alias("row"),
            F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id")).alias("order"),
            fingerprint_udf(shingle, seed)(F.col(text_col)).alias("fp"),
        ),
        "hashed",
    )
    classes = _classes(rows, distance, segments, pairwise).withColumnRenamed("fp", "of")
    return unpacked(
        rows.join(classes, F.col("fp") == F.col("of")),
        carry,
        {
            "fingerprint": F.lower(F.lpad(F.hex("fp"), 16, "0")),
            "component_id": F.col("first.id"),
        },
    )


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    seed: int = 42,
    segments: int = SEGMENTS,
    pairwise: int = PAIRWISE,
) -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of ``docs``.

    Where ids repeat a digest of the row decides, and of a repeated row one is
    kept. ``docs`` is read again for the rows that stay: pass a stored table.
    """
    ship(docs.sparkSession)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            row_digest(docs).alias("tie"),
            fingerprint_udf(shingle, seed)(F.col(text_col)).alias("fp"),
        ),
        "hashed",
    )
    order = F.struct(F.col("id").isNull().alias("last"), "id", "tie").alias("order")
    classes = _classes(rows.select("fp", order), distance, segments, pairwise).withColumnRenamed("fp", "of")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    decided = (
        rows.join(classes, F.col("fp") == F.col("of"))
        .groupBy("id", "tie")
        .agg(F.max(first).alias("kept"), F.count(F.lit(1)).alias("n"))
    )
    # few: what goes, and what is there more than once
    other = materialize(decided.where("NOT kept OR n > 1"), "decided")
    stays = rows_without(docs, id_col, other.select("id", "tie"))
    once = one_row_of(docs, id_col, other.where("kept"), "n").select("row")
    return stays.union(once).select(*[F.col("row")[c].alias(c) for c in docs.columns])
