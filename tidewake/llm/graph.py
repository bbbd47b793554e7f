"""Connected components of a link table, as rounds of joins that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewake.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours to the least of them: the larger ones, or the smaller ones and itself.

    Only the least neighbour per node is gathered, so a node with very many links costs one row a task.
    """
    links = _both(edges)
    links = links if large else links.where("b < a")
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = links.join(least, "a")
    moved = moved.where("b > a") if large else moved
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """Distinct links, written, and what tells them from others: their number and a sum of hashes."""
    seen = Observation()
    out = stored(links.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(
        F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return out, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): the smallest node it is connected with.

    Alternates the two star operations until nothing changes: the rounds grow with the logarithm
    of the longest path. Every round is written to the shared folder.
    """
    now, sign = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while sign != before:
        before = sign
        now, sign = _written(_star(_star(now, True), False))
    # every node now points at the least one of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
