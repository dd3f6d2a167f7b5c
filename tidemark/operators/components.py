"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def towards_least(edges: DataFrame) -> DataFrame:
    """One round over edges (v, u) with u < v: a node's larger neighbours and then all its neighbours are tied to the
    least one around it.  Both lookups are joins of written tables, whose hubs can be split between tasks."""
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    around = cut(both.groupBy(F.col("v").alias("x")).agg(F.least(F.min("u"), F.col("x")).alias("m")))
    larger = cut(both.withColumnRenamed("v", "x").join(around, "x").where("u > x and u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
    least = cut(larger.groupBy("v").agg(F.min("u").alias("m")))
    tied = larger.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
    return cut(tied.distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (v, u): the least node that each reaches.  Rounds go on until no edge
    changes; their number grows with the logarithm of a component's size.  Loops and repetitions are harmless."""
    now = cut(edges.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
    state = None
    while (seen := now.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()) != state and seen[0]:
        state, now = seen, towards_least(now)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
