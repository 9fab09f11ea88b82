"""Vertex programs in supersteps: messages along edges, combined by vertex, and an update of the vertices they reach.

A superstep is a join of the senders' values with the edges, an aggregate by target (partial sums meet before the
shuffle) and a join with the vertices. Edges are written once, and every few supersteps the vertices are written to
the shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Vertices are written after so many supersteps.
EVERY = 4


def run_supersteps(
    vertices: DataFrame,
    edges: DataFrame,
    message: Column,
    combine: Callable[[Column], Column],
    update: Callable[[DataFrame], DataFrame],
    steps: int | None = None,
    only_active: bool = False,
) -> DataFrame:
    """vertices (id, value[, active]) after `steps` supersteps, or when no vertex sends.

    message: of `value` and the edge's columns; combine: the aggregate of a vertex's messages; update: from (id,
    value, msg: null without messages) to (id, value, active). Messages to ids that are no vertices are dropped. With
    only_active just vertices whose `active` is true send.
    """
    edges = written(edges, "edges")
    vertices = vertices if "active" in vertices.columns else vertices.withColumn("active", F.lit(True))
    vertices = kept = written(vertices, "vertices")
    step = 0
    while steps is None or step < steps:
        senders = vertices.where("active") if only_active else vertices
        if steps is None and senders.isEmpty():
            break
        sent = senders.select(F.col("id").alias("src"), "value").join(edges, "src").select(F.col("dst").alias("id"), message.alias("msg"))
        received = sent.groupBy("id").agg(combine(F.col("msg")).alias("msg"))
        vertices = update(vertices.select("id", "value").join(received, "id", "left"))
        step += 1
        if steps is None or step % EVERY == 0 and step < steps:
            vertices = written(vertices, "vertices")
            discard(kept)
            kept = vertices
    return vertices


def out_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree; 0 for vertices without edges."""
    return vertices.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def page_rank(vertices: DataFrame, edges: DataFrame, updates: int = 10, damping: float = 0.8500000238418579) -> DataFrame:
    """id, rank: `updates` times rank = (1 - d) + d * sum(rank of source / its out-degree), from 1; not normalised.

    Vertices without out-edges pass nothing on.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = edges.select("src", "dst").join(degree, "src")
    start = vertices.select("id", F.lit(1.0).alias("value"))
    new = F.lit(1 - damping) + F.lit(damping) * F.coalesce("msg", F.lit(0.0))
    out = run_supersteps(start, weighted, F.col("value") / F.col("degree"), F.sum, lambda v: v.select("id", new.alias("value"), F.lit(True).alias("active")), updates)
    return out.select("id", F.col("value").alias("rank"))


UNREACHED = 2**63 - 1


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """id, distance over edges (src, dst, weight: not negative, bigint) from source; UNREACHED where there is no path.

    Each superstep relaxes only the out-edges of vertices that have just improved.
    """
    here = F.when(F.col("id") == source, F.lit(0)).otherwise(F.lit(UNREACHED)).cast("bigint")
    start = vertices.select("id", here.alias("value"), (F.col("id") == source).alias("active"))
    better = F.least("value", F.coalesce("msg", F.lit(UNREACHED).cast("bigint")))

    def update(v: DataFrame) -> DataFrame:
        return v.select("id", better.alias("value"), (better < F.col("value")).alias("active"))

    out = run_supersteps(start, edges, F.col("value") + F.col("weight"), F.min, update, None, only_active=True)
    return out.select("id", F.col("value").alias("distance"))
