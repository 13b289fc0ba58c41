"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import stage


def _stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node, or to larger ones only. Edges have u > v and are distinct."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("up")), F.struct(F.col("v").alias("node"), F.lit(False).alias("up")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.count_if("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours.

    Each edge gives one; equal ones are left to the small star.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (u, v): root is the least node of its component.

    Edges may repeat, point either way and be loops; nulls are not allowed. A node that has loops only is left out.
    `edges` is read twice, so it had better be staged. Each round is written to the shared folder; rounds grow with the
    logarithm of the diameter and end as soon as all edges are stars. No group of edges is gathered: minima are
    aggregated and joined back, and Spark splits the partitions of frequent nodes.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        now = stage(_small_star(stage(_large_star(now))))
        if _stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
