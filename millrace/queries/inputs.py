"""Queries over text lines; lines are the documents' or rendered from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import text as T
from .common import Registry, table

R = Registry()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


@R.query("SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)")
def line_count(spark, sf_dir):
    return T.line_count(_lines(spark, sf_dir))


@R.query("SELECT count(*) AS lines, CAST(sum(length(v)) AS BIGINT) AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS v FROM documents) WHERE NOT starts_with(v, '#') AND length(v) > 0")
def parse_comment_filter(spark, sf_dir):
    return T.data_lines(_lines(spark, sf_dir)).agg(F.count("*").alias("lines"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@R.query("SELECT o_orderkey AS key, o_orderpriority AS val FROM orders")
def parse_key_value(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    return T.parse_key_value(lines)


SPARSE = "concat(CAST(l_linenumber AS STRING), ' 0:', CAST(CAST(l_quantity AS INT) AS STRING), ' 3:', CAST(CAST(l_suppkey AS INT) AS STRING))"


@R.query("SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS label, CAST(3 AS INTEGER) AS last_index, CAST(l_quantity + l_suppkey AS DOUBLE) AS total FROM lineitem")
def parse_sparse_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr(SPARSE).alias("value"))
    rows = T.parse_sparse_rows(lines, label_type="int", classes=100)
    return rows.select("id", "label", F.array_max("idx").alias("last_index"), F.aggregate("val", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@R.query("SELECT CAST(l_orderkey AS INTEGER) AS row, CAST(l_linenumber AS INTEGER) AS col, CAST(l_quantity AS FLOAT) AS val FROM lineitem WHERE l_orderkey >= 1")
def parse_matrix_rows(spark, sf_dir):
    cell = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey >= 1").groupBy("l_orderkey").agg(F.concat(F.first("l_orderkey").cast("string"), F.lit(": "), F.concat_ws(" ", F.collect_list(cell))).alias("value"))
    return T.parse_matrix_rows(lines.select("value"))


@R.query("SELECT l_orderkey AS id, CAST(count(*) AS INTEGER) AS words, CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def parse_word_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat_ws("  ", F.collect_list(F.col("l_suppkey").cast("string"))).alias("value"))
    rows = T.parse_word_ids(lines)
    return rows.select("id", F.size("words").alias("words"), F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@R.query("SELECT l_orderkey AS src, l_suppkey AS dst, CAST(l_linenumber AS BIGINT) AS weight FROM lineitem")
def parse_adjacency_weighted(spark, sf_dir):
    pair = F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.first("l_orderkey").cast("string"), F.concat_ws(" ", F.collect_list(pair))).alias("value"))
    return T.parse_adjacency(lines.select("value"), weighted=True)[1]


@R.query("SELECT l_orderkey AS src, l_suppkey AS dst FROM lineitem")
def parse_adjacency(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.first("l_orderkey").cast("string"), F.concat_ws(" ", F.collect_list(F.col("l_suppkey").cast("string")))).alias("value"))
    return T.parse_adjacency(lines.select("value"), weighted=False)[1]


@R.query("SELECT CAST(n_nationkey AS INTEGER) AS idx, CASE WHEN n_nationkey = 24 THEN 'label' WHEN n_regionkey = 0 THEN 'continuous' ELSE 'categorical' END AS kind, CAST(n_regionkey AS INTEGER) AS size FROM nation")
def parse_feature_types(spark, sf_dir):
    pair = F.concat_ws(":", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    lines = table(spark, sf_dir, "nation").agg(F.concat_ws(" ", F.collect_list(pair)).alias("value"))
    return T.parse_feature_types(lines, 24)


@R.query("SELECT s_name AS host, s_acctbal AS amount FROM supplier")
def parse_hosts(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").select(F.concat_ws(" ", "s_name", F.col("s_acctbal").cast("string")).alias("value"))
    return T.parse_hosts(lines)


QUERIES, ORACLE = R.queries, R.oracle
