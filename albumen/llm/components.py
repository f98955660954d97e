"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node that each node of an edge can reach.

    Edges are pairs of longs; null ends, loops and repeated edges are dropped. Nodes
    without an edge are absent. Every round is written to the shared folder, hot nodes
    are reduced before the shuffle, and rounds go on until nothing changes."""
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        nxt = written(small_star(large_star(now)), "edges")
        state = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        same = state(now) == state(nxt)
        now = nxt
        if same:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
