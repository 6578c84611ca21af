"""Connected components of an undirected graph given as edges, without gathering any of it on one machine.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") shrink the graph to stars around each component's smallest node. Each step's minima are
written before they are joined back, so that both sides of the join are plain exchanges whose
oversized partitions the adaptive planner splits: a hub's links are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import _common as c


def _minima(both: DataFrame) -> DataFrame:
    return c.materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-minima")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component): the smallest node that can be reached. Nodes without an edge have no row.

    Loops, repeated pairs and pairs with a null are dropped; no edges give no rows.
    """
    edges = c.materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges"
    )
    before = None
    while True:
        both = _both_ways(edges)
        minima = _minima(both)
        large = c.materialize(
            both.join(minima, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large"
        )
        low = c.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-minima")
        small = c.materialize(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct(),
            "cc-small",
        )
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        for old in (edges, minima, large, low):
            c.discard(old)
        edges = small
        # stars only: each node has one link, the links' set stays as it was
        if state == before or state[0] == 0:
            break
        before = state
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
