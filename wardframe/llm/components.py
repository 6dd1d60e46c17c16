"""Connected components of an edge table by alternating star contractions.

Every round points each node of a neighbourhood to its smallest member: first the larger neighbours
(large star), then the smaller ones (small star). The edge table never grows beyond twice its size,
minima are combined before the shuffle, and the lineage is cut by a checkpoint in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node that can reach a smaller one.

    Smallest nodes themselves give no row: a node without one is its own component.
    Repeated edges, loops, either direction and NULL ends (ignored) are allowed.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = cut_lineage(now)
    mark = _mark(now)
    while True:
        now = cut_lineage(_stars(_stars(now, large=True), large=False))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def _mark(edges: DataFrame) -> tuple:
    """Row count and two order-free digests: equal for equal edge sets."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())
