"""Aggregates over run metrics: one row a measurement, with its source and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(records: DataFrame, source: str, order: list[Column], value: str, alpha: float, window: int = 0) -> DataFrame:
    """source, ema: sum((1-alpha)^i x_i) / sum((1-alpha)^i) over the newest `window` records (0: all), i = 0 the newest.

    order lists the newest first.
    """
    w = Window.partitionBy(source).orderBy(*order)
    rows = records.select(source, value, F.row_number().over(w).alias("_i"))
    if window:
        rows = rows.where(F.col("_i") <= window)
    weight = F.pow(F.lit(1 - alpha), F.col("_i") - 1)
    return rows.groupBy(source).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("ema"))


def after_warm_up(records: DataFrame, source: str, order: list[str], skip: int) -> DataFrame:
    """records without the first `skip` of each source."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return records.withColumn("_i", rank).where(F.col("_i") > skip).drop("_i")


def totals(records: DataFrame, source: str, value: str) -> DataFrame:
    """Records, sum, mean, least and greatest of each source."""
    v = F.col(value)
    return records.groupBy(source).agg(F.count("*").alias("records"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def ready_sources(records: DataFrame, source: str, minimum: int) -> DataFrame:
    """The sources with at least `minimum` records."""
    return records.groupBy(source).agg(F.count("*").alias("records")).where(F.col("records") >= minimum)


def epochs(batches: DataFrame, epoch: str, items: str, times: list[str]) -> DataFrame:
    """Each epoch's batches, items, summed times, and items a second of its first time (infinite for none)."""
    first = F.sum(times[0])
    rate = F.when(first == 0, F.lit(float("inf"))).otherwise(F.sum(items) / first)
    return batches.groupBy(epoch).agg(F.count("*").alias("batches"), F.sum(items).alias("items"), *[F.sum(t).alias(t) for t in times], rate.alias("rate"))


def timer(records: DataFrame, seconds: str, elements: str) -> DataFrame:
    """Total seconds, and seconds a record and an element; infinite where there are none."""
    total = F.coalesce(F.sum(seconds), F.lit(0.0))
    per = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(float("inf"))).otherwise(total / n)
    return records.agg(total.alias("total"), per(F.count(seconds)).alias("per_record"), per(F.sum(elements)).alias("per_element"))


def all_true(records: DataFrame, flag: str) -> DataFrame:
    """Whether every record has the flag; true for none."""
    return records.agg(F.coalesce(F.bool_and(flag), F.lit(True)).alias("all"))
