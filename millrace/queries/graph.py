"""Queries over the graph of customers (even ids) and suppliers (odd ids) that share an order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .common import Registry, table

R = Registry()


def graph(spark, sf_dir):
    """vertices (id) and edges (src, dst, weight) in both directions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") * 2 + 1).alias("s"), "l_linenumber")
    pairs = orders.join(lines, "o_orderkey").groupBy("c", "s").agg(F.min("l_linenumber").cast("bigint").alias("weight"))
    edges = pairs.select(F.col("c").alias("src"), F.col("s").alias("dst"), "weight").unionByName(pairs.select(F.col("s").alias("src"), F.col("c").alias("dst"), "weight"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    return customers.unionByName(suppliers), edges


GRAPH = """
WITH RECURSIVE pairs AS MATERIALIZED (
  SELECT o_custkey * 2 AS c, l_suppkey * 2 + 1 AS s, CAST(min(l_linenumber) AS BIGINT) AS weight
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
), edges AS MATERIALIZED (SELECT c AS src, s AS dst, weight FROM pairs UNION ALL SELECT s, c, weight FROM pairs),
vertices AS MATERIALIZED (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)
"""

RANKS = GRAPH + """, degree AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS v FROM vertices)
""" + "".join(
    f""", m{k} AS MATERIALIZED (SELECT e.dst AS id, sum(r.v / d.n) AS m FROM r{k - 1} r JOIN edges e ON e.src = r.id JOIN degree d ON d.src = r.id GROUP BY e.dst),
r{k} AS MATERIALIZED (SELECT v.id, (1 - 0.8500000238418579::DOUBLE) + 0.8500000238418579::DOUBLE * coalesce(m.m, 0) AS v FROM vertices v LEFT JOIN m{k} m ON m.id = v.id)
"""
    for k in range(1, 11)
) + " SELECT id, round(v, 6) AS rank FROM r10"


@R.query(RANKS)
def graph_pagerank(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir)
    return G.page_rank(vertices, edges).select("id", F.round("rank", 6).alias("rank"))


PATHS = GRAPH + """, d(id, dist) USING KEY (id) AS (
  SELECT id, CAST(0 AS BIGINT) FROM vertices WHERE id = 2
  UNION
  SELECT n.id, n.dist FROM (SELECT e.dst AS id, min(d.dist + e.weight) AS dist FROM d JOIN edges e ON e.src = d.id GROUP BY e.dst) n
  LEFT JOIN recurring.d AS old ON old.id = n.id WHERE old.dist IS NULL OR n.dist < old.dist
) SELECT v.id, coalesce(d.dist, 9223372036854775807) AS distance FROM vertices v LEFT JOIN d ON d.id = v.id
"""


@R.query(PATHS)
def graph_shortest_paths(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir)
    return G.shortest_paths(vertices, edges, 2)


@R.query(GRAPH + " SELECT v.id, count(e.src) AS degree FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id")
def graph_out_degrees(spark, sf_dir):
    return G.out_degrees(*graph(spark, sf_dir))


@R.query(GRAPH + " SELECT e.dst AS id, min(e.weight + e.src) AS msg FROM edges e GROUP BY e.dst")
def graph_combiner_min(spark, sf_dir):
    """One superstep's messages, of which the least reaches each vertex."""
    vertices, edges = graph(spark, sf_dir)
    start = vertices.select("id", F.col("id").alias("value"))
    out = G.run_supersteps(start, edges, F.col("value") + F.col("weight"), F.min, lambda v: v.select("id", F.col("msg").alias("value"), F.lit(True).alias("active")), 1)
    return out.where("value is not null").select("id", F.col("value").alias("msg"))


@R.query(GRAPH + " SELECT e.dst AS id, CAST(sum(e.weight) AS BIGINT) AS msg FROM edges e GROUP BY e.dst")
def graph_combiner_sum(spark, sf_dir):
    vertices, edges = graph(spark, sf_dir)
    start = vertices.select("id", F.lit(1).cast("bigint").alias("value"))
    out = G.run_supersteps(start, edges, F.col("value") * F.col("weight"), F.sum, lambda v: v.select("id", F.col("msg").alias("value"), F.lit(True).alias("active")), 1)
    return out.where("value is not null").select("id", F.col("value").alias("msg"))


QUERIES, ORACLE = R.queries, R.oracle
