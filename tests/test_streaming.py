from pyspark.sql import functions as F

from millrace.streaming import metrics as S


def test_windowed_totals(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:00:50", 2.0), ("b", "2024-01-01 00:01:10", 4.0)], "source string, ts string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = S.records(spark, f"{tmp_path}/in", "source string, ts timestamp, value double")
    q = S.windowed_totals(stream, "ts", "source", "value").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert {(r.source, r.records, r.total) for r in spark.table("totals").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}


def test_update_table(spark, tmp_path):
    init = spark.createDataFrame([(1, 10)], "key long, val long")
    args = ({"n": F.sum("val")}, {"val": F.lit(0).cast("long")}, {"val": F.col("val") + F.col("u_n")})
    for turn in range(2):
        spark.createDataFrame([(1, 1), (2, 5)], "key long, val long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.records(spark, f"{tmp_path}/in", "key long, val long", 1)
        S.update_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp", init, *args).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/1").collect()} == {(1, 12), (2, 10)}
