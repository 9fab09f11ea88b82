"""Shared helpers of the training-data operators: table access and skew-proof joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["ROW", "first_rows", "held_out", "join_groups", "numbered", "shared_dir", "table", "written"]

#: A group counts as hot when it holds more than this share of all rows; so at most 1/HOT_SHARE groups are hot.
HOT_SHARE = 0.002


#: Tables of fewer bytes are dealt evenly over all cores: they may be one row group, which is one task.
SMALL = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else rows


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to groups (one row a key, with its number of rows in `size`), however skewed the keys.

    Keys with over HOT_SHARE of all rows are at most 1/HOT_SHARE many, so they are broadcast; the rest is a shuffled
    join whose largest key is bounded. rows is read twice: give it as a written table. Null keys are dropped.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    on_hot = rows.join(F.broadcast(hot), key)
    on_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return on_hot.unionByName(on_cold)


#: A row's number, which is fixed with the written table: doc_id may be null or repeated.
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def first_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of numbered rows one of each group, of the smallest doc_id (nulls last), then number; groups: ROW, _group."""
    ids = groups.join(rows.select(ROW, F.col("doc_id").cast("long").alias("_id")), ROW)
    first = ids.groupBy("_group").agg(F.min(F.struct(F.isnull("_id").alias("last"), "_id", ROW)).alias("_first"))
    return rows.join(first.select(F.col(f"_first.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)


def held_out(doc_id: str, modulus: int) -> F.Column:
    """crc32(doc_id as text) mod modulus is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 2
