"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm.common import checkpointed


# Edges in a partition at most; short lists take few partitions, whatever the session's number is.
EDGES = 100_000
PARTITIONS = 8


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.coalesce(parts).distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct()


def _state(edges: DataFrame, parts: int) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars around their smallest nodes.

    In a star every node but the smallest hangs on one node, which hangs on none.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(parts)
    found = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()
    return found[0] or 0, found[1]


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every linked node; the label is the component's smallest node."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges.filter("a > b"))
    n, loose = _state(edges, PARTITIONS)
    while loose:
        parts = max(PARTITIONS, n // EDGES)
        edges = edges.coalesce(parts)
        edges = checkpointed(_small_star(_large_star(edges, parts), parts).coalesce(parts))
        n, loose = _state(edges, parts)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
