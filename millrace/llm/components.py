"""Connected components of a link table by alternating large-star and small-star steps, each a groupBy and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .base import join_groups, written


def _star(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """Each node u links its larger (large-star) or smaller (small-star) neighbours to the least of its neighbourhood."""
    if small:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        rows = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
    both = join_groups(rows, least, "u", "size", total)
    if small:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v: long): the least node reachable. Loops and null ends are ignored.

    The edges converge to one star a component, in a number of rounds that grows with the logarithm of the longest
    path. Each round's edges are a written table; only their number and a checksum come to the driver.
    """
    edges = written(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, _measure(edges)
    while now != before and now[0]:
        before = now
        wide = written(_star(edges, 2 * now[0], small=False), "edges")
        discard(edges)
        # Large stars have no more edges than there were before them.
        edges = written(_star(wide, now[0], small=True), "edges")
        discard(wide)
        now = _measure(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
