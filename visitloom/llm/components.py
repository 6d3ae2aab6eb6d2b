"""Connected components of an edge table, by alternating stars.

Each round hangs every node under smaller ones: first the children of a node go
to its smallest parent, then the parents of a node go under the smallest of
them. Trees flatten fast, so a few rounds do. Groups are only ever aggregated or
joined, never gathered, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.session import materialize


def _smallest_parent(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child").alias("node")).agg(
        F.min("parent").alias("least"), F.count(F.lit(1)).alias("n_parents")
    )


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node but the roots.

    Edges have no direction and may repeat. An edge with a null end or from a
    node to itself links nothing. No edges give an empty table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    flat = materialize(
        edges.select(high.alias("child"), low.alias("parent")).distinct(), "edges"
    )
    while True:
        up = _smallest_parent(flat)
        chained = flat.join(up, flat["parent"] == up["node"], "left_semi")
        twice = up.where("n_parents > 1")
        if chained.isEmpty() and twice.isEmpty():
            return flat.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        raised = materialize(
            flat.join(up, flat["parent"] == up["node"], "left")
            .select("child", F.coalesce("least", "parent").alias("parent"))
            .distinct(),
            "raised",
        )
        up = _smallest_parent(raised)
        others = (
            raised.join(up.where("n_parents > 1"), raised["child"] == F.col("node"))
            .where("parent != least")
            .select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        )
        flat = materialize(
            up.select(F.col("node").alias("child"), F.col("least").alias("parent"))
            .union(others)
            .distinct(),
            "flat",
        )
