"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and minimum aggregations over the edges, written to the shared
checkpoint folder; neither edges nor components reach the driver, which sees one count and one
checksum a round. The joins carry a second key beside the node, so that both sides are dealt
by plain exchanges and adaptive execution can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import materialize


def _high(node: str) -> Column:
    return F.shiftright(node, 32).alias("high")


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", _high("u"), F.least("u", "m").alias("m"))
    return edges.select("u", "v", _high("u")).join(least, ["u", "high"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long) that isn't its component's
    smallest node itself; root is that smallest node. Loops and nulls are left out."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_minimum(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialize(moved.filter("u <> v").distinct())
