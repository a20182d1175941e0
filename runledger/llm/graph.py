"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import written


def components(links: DataFrame, compression: str = "zstd") -> DataFrame:
    """(u, v): each linked node with the smallest node of its component, by
    alternating large-star and small-star steps until nothing changes.

    An edge (u, v), u > v, moves to v's own smallest neighbour (large star); then the
    ends of u's edges move to the smallest of them (small star).  Each step leaves one
    edge for an edge, equal ones of a node are dropped with the sort that finds the
    smallest: three shuffles a round.  The edges of one node as u, numbers only, are
    sorted in one task."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    of_u = Window.partitionBy("u").orderBy("v")
    while True:
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(low, "v", "left").select(
            "u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        small = large.select(
            "u", "v", "moved", F.first("v").over(of_u).alias("m"),
            F.coalesce(F.lag("v").over(of_u) != F.col("v"), F.lit(True)).alias("once"),
            F.max("moved").over(of_u.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("any"))
        other = F.col("v") != F.col("m")
        moved = written(small.where("once").select(
            F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"),
            (other | F.col("any")).alias("moved")), "edges", compression)
        edges = moved.select("u", "v")
        if moved.where("moved").isEmpty():
            return edges
