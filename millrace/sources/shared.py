"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.millrace.test.dir", None)
        if not found:
            found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
            spark.conf.set("spark.millrace.test.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, by: list[str], buckets: int) -> DataFrame:
    """As written(), and dealt into buckets by the hash of `by`: joins and groups by these columns don't shuffle it again."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._written_at, out._table = path, name
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that written() or bucketed() made, once nothing that is still to be computed reads it."""
    if hasattr(df, "_table"):
        df.sparkSession.sql(f"DROP TABLE {df._table}")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
