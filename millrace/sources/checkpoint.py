"""Checkpoint and restore of keyed tables, whole or by a share of each block's first keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_blocks(table: DataFrame, ratio: float, block: str = "block_id", key: str = "key") -> DataFrame:
    """Of each block the first floor(rows * ratio) rows by key. 0 < ratio <= 1.

    The block's size comes from an aggregate and the rank from one window, so a block is sorted, never collected.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    sizes = table.groupBy(block).agg(F.count("*").alias("_size"))
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(block).orderBy(key)))
    return ranked.join(sizes, block).where(F.col("_rank") <= F.floor(F.col("_size") * ratio)).drop("_rank", "_size")


def checkpoint(table: DataFrame, path: str, config: dict | None = None, ratio: float = 1.0, block: str = "block_id", key: str = "key") -> str:
    """Writes table (a folder for each block) and its configuration under path, which is returned as the checkpoint's id."""
    rows = table if ratio == 1 else sample_blocks(table, ratio, block, key)
    rows.write.partitionBy(block).parquet(f"{path}/data")
    spark = table.sparkSession
    meta = json.dumps({"config": config or {}, "ratio": ratio, "schema": json.loads(table.schema.json())})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.text(f"{path}/meta")
    return path


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The checkpoint's table, with its columns as they were, and its configuration."""
    from pyspark.sql.types import StructType

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    schema = StructType.fromJson(meta["schema"])
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names), meta["config"]
