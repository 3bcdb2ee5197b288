"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, small_side


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over landed edges (u, v), u > v. Neighbour minima are map-side combined aggregates and come back
    by a join with their landed rows, so that no neighbour list is ever collected and a hub's rows are not
    shuffled (few nodes: broadcast) or can be split."""
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = land(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
    if large:
        up = pairs.filter("v > u").join(small_side(low), "u")
        return up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    pointed = edges.join(small_side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the smallest node reachable, for every node that
    has an edge to another. Self-loops, repeated edges and nulls are ignored; no edges: no rows.

    Each round is landed in the shared folder. The rounds end when one changes nothing, told by the
    row count and an order-free sum of row hashes, two numbers on the driver.
    """
    cur = land(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct(),
        "cc",
    )
    state = None
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
        cur = land(_star(land(_star(cur, large=True), "cc"), large=False), "cc")
