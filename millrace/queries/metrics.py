"""Queries of metric aggregates, ranges and cost estimates over events, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranges as G
from ..plans import costs as C
from .common import Registry, table

R = Registry()


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", "event_id", "value")


EMA = """
WITH e AS (SELECT user_id AS source, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT source, round(sum(pow(0.7, i - 1) * value) / sum(pow(0.7, i - 1)), 6) AS ema FROM e {where} GROUP BY source
"""


@R.query(EMA.format(where="WHERE i <= 10"))
def metrics_moving_average(spark, sf_dir):
    out = M.moving_average(_events(spark, sf_dir), "source", [F.desc("ts"), F.desc("event_id")], "value", 0.3, 10)
    return out.select("source", F.round("ema", 6).alias("ema"))


@R.query(EMA.format(where=""))
def metrics_moving_average_all(spark, sf_dir):
    out = M.moving_average(_events(spark, sf_dir), "source", [F.desc("ts"), F.desc("event_id")], "value", 0.3)
    return out.select("source", F.round("ema", 6).alias("ema"))


@R.query("SELECT source, event_id FROM (SELECT user_id AS source, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i > 3")
def metrics_after_warm_up(spark, sf_dir):
    return M.after_warm_up(_events(spark, sf_dir), "source", ["ts", "event_id"], 3).select("source", "event_id")


@R.query("SELECT user_id AS source, count(*) AS records, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY user_id")
def metrics_totals(spark, sf_dir):
    return M.totals(_events(spark, sf_dir), "source", "value").select("source", "records", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most")


@R.query("SELECT user_id AS source, count(*) AS records FROM events GROUP BY user_id HAVING count(*) >= 60")
def metrics_ready_sources(spark, sf_dir):
    return M.ready_sources(_events(spark, sf_dir), "source", 60)


@R.query("SELECT l_linenumber AS epoch, count(*) AS batches, CAST(sum(l_quantity) AS DOUBLE) AS items, round(sum(l_discount), 4) AS comp, round(sum(l_tax), 4) AS pull, round(sum(l_quantity) / sum(l_discount), 3) AS rate FROM lineitem GROUP BY 1")
def metrics_epochs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("items"), F.col("l_discount").alias("comp"), F.col("l_tax").alias("pull"))
    out = M.epochs(rows, "epoch", "items", ["comp", "pull"])
    return out.select("epoch", "batches", "items", F.round("comp", 4).alias("comp"), F.round("pull", 4).alias("pull"), F.round("rate", 3).alias("rate"))


@R.query("SELECT round(sum(l_tax), 3) AS total, round(sum(l_tax) / count(*), 6) AS per_record, round(sum(l_tax) / sum(l_quantity), 6) AS per_element FROM lineitem")
def metrics_timer(spark, sf_dir):
    out = M.timer(table(spark, sf_dir, "lineitem"), "l_tax", "l_quantity")
    return out.select(F.round("total", 3).alias("total"), F.round("per_record", 6).alias("per_record"), F.round("per_element", 6).alias("per_element"))


@R.query("""
WITH k AS (SELECT DISTINCT o_custkey AS cust, o_orderkey // 4 AS v FROM orders), i AS (SELECT cust, v, v - row_number() OVER (PARTITION BY cust ORDER BY v) AS g FROM k)
SELECT cust, min(v) AS lo, max(v) AS hi FROM i GROUP BY cust, g
""")
def ranges_dense(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.floor(F.col("o_orderkey") / 4).alias("v"))
    return G.dense_ranges(rows, "v", "cust")


PAIRS = "SELECT o_orderkey AS id, o_orderkey % 50 AS a_lo, o_orderkey % 50 + o_custkey % 20 AS a_hi, o_custkey % 50 AS b_lo, o_custkey % 50 + 7 AS b_hi FROM orders"


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("a_lo"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 20).alias("a_hi"), (F.col("o_custkey") % 50).alias("b_lo"), (F.col("o_custkey") % 50 + 7).alias("b_hi"))


@R.query(f"SELECT id, greatest(a_lo, b_lo) AS lo, least(a_hi, b_hi) AS hi FROM ({PAIRS}) WHERE greatest(a_lo, b_lo) <= least(a_hi, b_hi)")
def ranges_intersect(spark, sf_dir):
    return G.intersect(_pairs(spark, sf_dir)).select("id", "lo", "hi")


@R.query(f"""
WITH p AS ({PAIRS}) SELECT id, a_lo AS lo, a_hi AS hi FROM p WHERE b_lo > a_hi OR b_hi < a_lo
UNION ALL SELECT id, a_lo, b_lo - 1 FROM p WHERE b_lo <= a_hi AND b_hi >= a_lo AND a_lo < b_lo
UNION ALL SELECT id, b_hi + 1, a_hi FROM p WHERE b_lo <= a_hi AND b_hi >= a_lo AND b_hi < a_hi
""")
def ranges_complement(spark, sf_dir):
    return G.complement(_pairs(spark, sf_dir)).select("id", "lo", "hi")


@R.query('SELECT bool_and(l_quantity > 0) AS "all" FROM lineitem')
def metrics_all_true(spark, sf_dir):
    return M.all_true(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 0).alias("flag")), "flag")


EVALUATORS = "SELECT s_suppkey AS id, (s_suppkey % 7 + 1) * 1.0::DOUBLE AS throughput, (s_suppkey % 5 + 1) * 10.0::DOUBLE AS bandwidth FROM supplier WHERE s_suppkey <= 24"


def _evaluators(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 24")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("throughput"), ((F.col("s_suppkey") % 5 + 1) * 10).cast("double").alias("bandwidth"))


COSTS = f"""
WITH e AS ({EVALUATORS}), r AS (SELECT *, row_number() OVER (ORDER BY throughput DESC, id) AS rank FROM e),
w AS (SELECT unnest(range(1, (SELECT count(*) FROM e))) AS workers),
p AS (SELECT *, sum(CASE WHEN rank > workers THEN bandwidth END) OVER (PARTITION BY workers) AS serving FROM r CROSS JOIN w)
SELECT CAST(workers AS INTEGER) AS workers, round(100.0 / sum(1 / (1 / throughput + 0.5 * greatest(1 / bandwidth, workers / serving))), 6) AS cost
FROM p WHERE rank <= workers GROUP BY workers
"""


@R.query(COSTS)
def cost_by_workers(spark, sf_dir):
    return C.worker_costs(_evaluators(spark, sf_dir), 0.5, 100).select("workers", F.round("cost", 6).alias("cost"))


@R.query(f"SELECT arg_min(workers, (cost, workers)) AS workers, min(cost) AS cost FROM ({COSTS})")
def cost_cheapest(spark, sf_dir):
    return C.cheapest(C.worker_costs(_evaluators(spark, sf_dir), 0.5, 100)).select("workers", F.round("cost", 6).alias("cost"))


SPREAD = f"""
SELECT id, CAST(base + CASE WHEN row_number() OVER (ORDER BY bandwidth DESC, id) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS blocks
FROM (SELECT id, bandwidth, floor(1000 * bandwidth / sum(bandwidth) OVER ()) AS base FROM ({EVALUATORS}))
"""


@R.query(SPREAD)
def cost_rebalanced(spark, sf_dir):
    return C.rebalanced(_evaluators(spark, sf_dir), "bandwidth", 1000)


@R.query(f"""
WITH d AS (SELECT id, 1000 // 24 + CASE WHEN id <= 1000 % 24 THEN 1 ELSE 0 END - blocks AS d FROM ({SPREAD})),
s AS (SELECT id AS src, sum(d) OVER (ORDER BY d DESC, id) - d AS lo, sum(d) OVER (ORDER BY d DESC, id) AS hi FROM d WHERE d > 0),
t AS (SELECT id AS dst, sum(-d) OVER (ORDER BY d, id) + d AS lo, sum(-d) OVER (ORDER BY d, id) AS hi FROM d WHERE d < 0)
SELECT src, dst, CAST(least(s.hi, t.hi) - greatest(s.lo, t.lo) AS BIGINT) AS blocks FROM s JOIN t ON s.lo < t.hi AND t.lo < s.hi
""")
def cost_block_moves(spark, sf_dir):
    """From an even spread to one by bandwidth."""
    e = _evaluators(spark, sf_dir)
    even = e.select("id", (F.lit(1000 // 24).cast("bigint") + F.when(F.col("id") <= 1000 % 24, 1).otherwise(0)).alias("blocks"))
    return C.moves(even, C.rebalanced(e, "bandwidth", 1000))


#: A machine for each nation, from all suppliers.
NATIONS = "SELECT s_nationkey AS id, count(*)::DOUBLE AS throughput, sum(s_suppkey % 5 + 1)::DOUBLE * 10 AS bandwidth FROM supplier GROUP BY s_nationkey"


def _nations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id"))
    return s.agg(F.count("*").cast("double").alias("throughput"), (F.sum(F.col("s_suppkey") % 5 + 1).cast("double") * 10).alias("bandwidth"))


COSTS_ALL, SPREAD_ALL = COSTS.replace(EVALUATORS, NATIONS), SPREAD.replace(EVALUATORS, NATIONS)


@R.query(COSTS_ALL)
def cost_by_workers_all(spark, sf_dir):
    return C.worker_costs(_nations(spark, sf_dir), 0.5, 100).select("workers", F.round("cost", 6).alias("cost"))


@R.query(f"SELECT arg_min(workers, (cost, workers)) AS workers, min(cost) AS cost FROM ({COSTS_ALL})")
def cost_cheapest_all(spark, sf_dir):
    return C.cheapest(C.worker_costs(_nations(spark, sf_dir), 0.5, 100)).select("workers", F.round("cost", 6).alias("cost"))


@R.query(SPREAD_ALL)
def cost_rebalanced_all(spark, sf_dir):
    return C.rebalanced(_nations(spark, sf_dir), "bandwidth", 1000)


@R.query(f"""
WITH e AS (SELECT id, count(*) OVER () AS n, row_number() OVER (ORDER BY id) AS k FROM ({NATIONS})),
d AS (SELECT id, 1000 // n + CASE WHEN k <= 1000 % n THEN 1 ELSE 0 END - blocks AS d FROM e JOIN ({SPREAD_ALL}) USING (id)),
s AS (SELECT id AS src, sum(d) OVER (ORDER BY d DESC, id) - d AS lo, sum(d) OVER (ORDER BY d DESC, id) AS hi FROM d WHERE d > 0),
t AS (SELECT id AS dst, sum(-d) OVER (ORDER BY d, id) + d AS lo, sum(-d) OVER (ORDER BY d, id) AS hi FROM d WHERE d < 0)
SELECT src, dst, CAST(least(s.hi, t.hi) - greatest(s.lo, t.lo) AS BIGINT) AS blocks FROM s JOIN t ON s.lo < t.hi AND t.lo < s.hi
""")
def cost_block_moves_all(spark, sf_dir):
    """From an even spread to one by bandwidth."""
    e = _nations(spark, sf_dir)
    return C.moves(C.rebalanced(e.withColumn("even", F.lit(1)), "even", 1000), C.rebalanced(e, "bandwidth", 1000))


@R.query("SELECT DISTINCT l_orderkey % 500 AS id FROM lineitem WHERE l_orderkey % 500 NOT IN (SELECT l_partkey % 700 FROM lineitem WHERE l_quantity < 2)")
def plan_roots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    nodes = lines.select((F.col("l_orderkey") % 500).alias("id")).distinct()
    return C.roots(nodes, lines.where("l_quantity < 2").select((F.col("l_partkey") % 700).alias("dst")))


@R.query("SELECT n.id, count(e.dst) AS waits_for FROM (SELECT DISTINCT l_orderkey % 500 AS id FROM lineitem) n LEFT JOIN (SELECT l_partkey % 700 AS dst FROM lineitem WHERE l_quantity < 2) e ON e.dst = n.id GROUP BY n.id")
def plan_in_degrees(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    nodes = lines.select((F.col("l_orderkey") % 500).alias("id")).distinct()
    return C.in_degrees(nodes, lines.where("l_quantity < 2").select((F.col("l_partkey") % 700).alias("dst")))


@R.query("SELECT s_suppkey AS id, coalesce(n_nationkey, 99) AS nation, round(s_acctbal, 2) AS amount FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def lookup_with_default(spark, sf_dir):
    """A small table's values looked up by key, with a default."""
    hosts = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "supplier").join(hosts, "s_nationkey", "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.coalesce("nation", F.lit(99)).alias("nation"), F.round("s_acctbal", 2).alias("amount"))


QUERIES, ORACLE = R.queries, R.oracle
