"""Cost estimates from run metrics: how many of n evaluators should be workers, and how blocks should be spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def worker_costs(evaluators: DataFrame, pull: float, batches: int) -> DataFrame:
    """workers, cost for each split of evaluators (id, throughput: seconds a batch's inverse, bandwidth).

    With w workers the fastest w work and the others serve: t = 1 / throughput + pull * max(1 / bandwidth, w / the
    servers' bandwidth), and the cost is batches / sum of 1 / t. evaluators is one row a machine, so small.
    """
    w = Window.orderBy(F.desc("throughput"), "id")
    ranked = evaluators.select("id", "throughput", "bandwidth", F.row_number().over(w).alias("rank"))
    n = evaluators.agg(F.count("*").alias("n"))
    sizes = n.where("n > 1").select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - 1)).alias("workers"))
    pairs = ranked.join(F.broadcast(sizes), F.lit(True))
    serving = F.sum(F.when(F.col("rank") > F.col("workers"), F.col("bandwidth"))).over(Window.partitionBy("workers"))
    t = 1 / F.col("throughput") + F.lit(pull) * F.greatest(1 / F.col("bandwidth"), F.col("workers") / F.col("serving"))
    working = pairs.withColumn("serving", serving).where(F.col("rank") <= F.col("workers"))
    return working.groupBy("workers").agg((F.lit(float(batches)) / F.sum(1 / t)).alias("cost"))


def cheapest(costs: DataFrame, current: int | None = None, threshold: float = 0.0) -> DataFrame:
    """The split of least cost (the fewest workers of equal ones), or the current one if the gain is below threshold."""
    best = costs.agg(F.min_by("workers", F.struct("cost", "workers")).alias("workers"), F.min("cost").alias("cost"))
    if current is None:
        return best
    now = costs.where(F.col("workers") == current).select(F.col("cost").alias("now"))
    both = best.join(F.broadcast(now), F.lit(True), "left")
    stay = (F.col("now") - F.col("cost")) / F.col("now") < threshold
    return both.select(F.when(stay, F.lit(current)).otherwise(F.col("workers")).alias("workers"), F.when(stay, F.col("now")).otherwise(F.col("cost")).alias("cost"))


def rebalanced(owners: DataFrame, weight: str, blocks: int) -> DataFrame:
    """id, blocks: in proportion to weight, rounded down; the rest one each to the heaviest."""
    total = F.sum(weight).over(Window.partitionBy())
    share = owners.select("id", weight, F.floor(F.lit(blocks) * F.col(weight) / total).cast("bigint").alias("base"))
    rest = F.lit(blocks) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(weight), "id"))
    return share.select("id", (F.col("base") + F.when(rank <= rest, 1).otherwise(0)).alias("blocks"))


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """src, dst, blocks that turn one spread (id, blocks) into another: surpluses and deficits matched in order of size.

    Both are laid end to end on the same line; where a surplus and a deficit overlap, their overlap moves.
    """
    diff = before.withColumnRenamed("blocks", "_b").join(after, "id", "full_outer").select("id", (F.coalesce("_b", F.lit(0)) - F.coalesce("blocks", F.lit(0))).alias("d"))

    def laid(sign: int, name: str) -> DataFrame:
        side = diff.where(F.col("d") * sign > 0).select(F.col("id").alias(name), (F.col("d") * sign).alias("n"))
        w = Window.orderBy(F.desc("n"), name)
        end = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return side.select(name, (end - F.col("n")).alias(f"{name}_lo"), end.alias(f"{name}_hi"))

    src, dst = laid(1, "src"), laid(-1, "dst")
    both = src.join(F.broadcast(dst), (F.col("src_lo") < F.col("dst_hi")) & (F.col("dst_lo") < F.col("src_hi")))
    return both.select("src", "dst", (F.least("src_hi", "dst_hi") - F.greatest("src_lo", "dst_lo")).alias("blocks"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the steps of a plan that wait for no other."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits_for"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("waits_for", F.lit(0)).alias("waits_for"))
