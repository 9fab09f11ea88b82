"""Closed ranges of whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_ranges(numbers: DataFrame, value: str, group: str) -> DataFrame:
    """group, lo, hi of the maximal runs of consecutive values in each group; repeated values count once."""
    w = Window.partitionBy(group).orderBy(value)
    island = numbers.select(group, value).distinct().withColumn("_i", F.col(value) - F.row_number().over(w))
    return island.groupBy(group, "_i").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_i")


def intersect(pairs: DataFrame) -> DataFrame:
    """pairs (a_lo, a_hi, b_lo, b_hi, ...) with lo and hi of what both have; pairs without any are left out."""
    return pairs.withColumn("lo", F.greatest("a_lo", "b_lo")).withColumn("hi", F.least("a_hi", "b_hi")).where("lo <= hi")


def complement(pairs: DataFrame) -> DataFrame:
    """For each pair the 0, 1 or 2 ranges of a that b does not have, as lo and hi."""
    left = F.struct(F.col("a_lo").alias("lo"), F.least(F.col("a_hi"), F.col("b_lo") - 1).alias("hi"))
    right = F.struct(F.greatest(F.col("a_lo"), F.col("b_hi") + 1).alias("lo"), F.col("a_hi").alias("hi"))
    apart = (F.col("b_lo") > F.col("a_hi")) | (F.col("b_hi") < F.col("a_lo"))
    parts = F.when(apart, F.array(F.struct(F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")))).otherwise(F.filter(F.array(left, right), lambda r: r["lo"] <= r["hi"]))
    return pairs.select("*", F.explode(parts).alias("_r")).select("*", "_r.lo", "_r.hi").drop("_r")


def expand(ranges: DataFrame, value: str = "value") -> DataFrame:
    return ranges.select("*", F.explode(F.sequence("lo", "hi")).alias(value))
