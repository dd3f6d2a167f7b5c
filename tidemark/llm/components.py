"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, tidy

#: Edges that a task reduces together, and the number of edges that one task finishes (16 bytes each, in bounded memory).
LOCAL_EDGES, FEW_EDGES = 250_000, 250_000
#: Rows of 16 bytes that may be broadcast.
BROADCAST_ROWS = 500_000


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each LOCAL_EDGES by a star forest with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def forest() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_pydict({"v": pa.array([x for x, _ in pairs], pa.int64()), "u": pa.array([r for _, r in pairs], pa.int64())})

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        held += len(batch)
        if held >= LOCAL_EDGES:
            yield forest()
            held = 0
    if parent:
        yield forest()


def to_least(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """``edges`` with m, the least node of each ``key``.  ``least`` is a table of its own, so that it can be broadcast
    within BROADCAST_ROWS and beyond that a hub's edges can be split between tasks."""
    return edges.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least.hint("merge"), key)


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (v, u) with u < v."""
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
    large = materialize(to_least(both, "x", least).where("y > x and y > m").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), "large")
    below = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "below")
    small = to_least(large, "v", below).select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
    out = materialize(small.mapInArrow(tidy(local_forest), "v long, u long").distinct(), "edges")
    discard(least, large, below)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Null ends and self-loops are ignored, repeated edges are harmless, an empty table gives an empty result.  Each
    round is a written table, so lineage stays short; edges are reduced to forests in each task first.  Rounds go on
    until nothing changes; as soon as no more than FEW_EDGES are left, one task joins them all.
    """
    now = (
        edges.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .mapInArrow(tidy(local_forest), "v long, u long")
        .distinct()
    )
    now = materialize(now, "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == state or seen[0] <= FEW_EDGES:
            break
        state, old = seen, now
        now = star(old)
        discard(old)
    if seen[0] <= FEW_EDGES:
        now = now.coalesce(1).mapInArrow(tidy(local_forest), "v long, u long")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
