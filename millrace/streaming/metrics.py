"""Run metrics as a stream: files of records that arrive in a folder, aggregated by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import update


def records(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_totals(stream: DataFrame, time: str, source: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records and sum by source and time window; records later than `late` are dropped and closed windows forgotten."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    totals = timed.groupBy(F.window(time, width), source).agg(F.count("*").alias("records"), F.sum(value).alias("total"))
    return totals.select(F.col("window.start").alias("start"), source, "records", "total")


def update_table(stream: DataFrame, path: str, checkpoint: str, init: DataFrame, fold: dict, start: dict, apply: dict, key: str = "key"):
    """Folds each micro-batch of updates into a keyed table: version n of it is written to path/n, from init on.

    A batch that is run again writes the same version again, so a lost driver repeats nothing. Returns the query, for
    all that is there now.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        table = init if n == 0 else spark.read.parquet(f"{path}/{n - 1}")
        update(table, batch, fold, start, apply, key).write.mode("overwrite").parquet(f"{path}/{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
