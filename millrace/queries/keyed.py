"""Queries over keyed tables: orders as keys and values, customers updated by their orders, events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed as K
from ..sources import checkpoint as C
from ..sources import text as T
from .common import Registry, exact_sum, table

R = Registry()

OLD = "SELECT o_orderkey AS key, o_totalprice AS val FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey AS key, o_totalprice * 2 AS val FROM orders WHERE o_orderkey % 2 = 0"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("val"))


def _old(spark, sf_dir):
    return _orders(spark, sf_dir).where("key % 3 <> 0")


def _new(spark, sf_dir):
    return _orders(spark, sf_dir).where("key % 2 = 0").withColumn("val", F.col("val") * 2)


@R.query(f"SELECT coalesce(n.key, o.key) AS key, coalesce(n.val, o.val) AS val FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.key = n.key")
def kv_put(spark, sf_dir):
    return K.put(_old(spark, sf_dir), _new(spark, sf_dir))


@R.query(f"SELECT coalesce(o.key, n.key) AS key, coalesce(o.val, n.val) AS val FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.key = n.key")
def kv_put_if_absent(spark, sf_dir):
    return K.put_if_absent(_old(spark, sf_dir), _new(spark, sf_dir))


@R.query(f"SELECT o.key, o.val FROM ({OLD}) o JOIN ({NEW}) n ON o.key = n.key")
def kv_multi_put_previous(spark, sf_dir):
    return K.previous(_old(spark, sf_dir), _new(spark, sf_dir))


@R.query("SELECT o_orderkey AS key, o_totalprice AS val FROM orders WHERE o_orderkey = 7")
def kv_get(spark, sf_dir):
    return K.get(_orders(spark, sf_dir), 7)


@R.query("SELECT p_partkey AS key, p_brand AS val FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 50 = 0)")
def kv_pull(spark, sf_dir):
    """The part rows that a batch of orders' key lists name."""
    batch = table(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("keys"))
    return K.pull(_parts(spark, sf_dir), batch, "keys")


@R.query("SELECT p_partkey AS key, p_brand AS val FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def kv_pull_all(spark, sf_dir):
    """The part rows that all orders' key lists name."""
    batch = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("keys"))
    return K.pull(_parts(spark, sf_dir), batch, "keys")


@R.query("SELECT DISTINCT l_partkey AS key FROM lineitem")
def kv_used_keys(spark, sf_dir):
    return K.used_keys(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("keys")), "keys")


ASKED = "SELECT DISTINCT l_partkey + 3 AS key FROM lineitem WHERE l_quantity > 45"
PARTS = "SELECT p_partkey AS key, p_brand AS val FROM part"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select((F.col("l_partkey") + 3).alias("key")).distinct()


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("val"))


@R.query(f"SELECT p.key, p.val FROM ({PARTS}) p JOIN ({ASKED}) a ON p.key = a.key")
def kv_multi_get(spark, sf_dir):
    return K.multi_get(_parts(spark, sf_dir), _asked(spark, sf_dir))


@R.query(f"SELECT a.key, coalesce(p.val, 'INIT_' || a.key) AS val FROM ({ASKED}) a LEFT JOIN ({PARTS}) p ON p.key = a.key")
def kv_get_or_init(spark, sf_dir):
    return K.get_or_init(_parts(spark, sf_dir), _asked(spark, sf_dir), {"val": F.concat(F.lit("INIT_"), F.col("key").cast("string"))})[0]


@R.query(f"SELECT coalesce(p.key, a.key) AS key, coalesce(p.val, 'INIT_' || a.key) AS val FROM ({ASKED}) a FULL JOIN ({PARTS}) p ON p.key = a.key")
def kv_get_or_init_table(spark, sf_dir):
    return K.get_or_init(_parts(spark, sf_dir), _asked(spark, sf_dir), {"val": F.concat(F.lit("INIT_"), F.col("key").cast("string"))})[1]


SPENT = """
WITH u AS (SELECT o_custkey AS key, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(c.c_custkey, u.key) AS key, round(coalesce(c.c_acctbal, 0.0) + coalesce(CAST(u.total AS DOUBLE), 0.0), 2) AS balance,
       CAST(coalesce(u.n, 0) AS BIGINT) AS orders
FROM customer c FULL JOIN u ON c.c_custkey = u.key
"""


@R.query(SPENT)
def kv_update_fold(spark, sf_dir):
    """Many updates a key, folded before they meet the table; keys without a row are initialised."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit(0).cast("bigint").alias("orders"))
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_totalprice")
    fold = {"total": exact_sum("o_totalprice"), "n": F.count("*")}
    out = K.update(accounts, updates, fold, {"balance": F.lit(0.0), "orders": F.lit(0).cast("bigint")}, {"balance": F.col("balance") + F.col("u_total"), "orders": F.col("orders") + F.col("u_n")})
    return out.withColumn("balance", F.round("balance", 2))


@R.query("""
SELECT user_id % 8 AS key, CAST(count(*) * 3 AS BIGINT) AS val FROM events GROUP BY 1
""")
def kv_add_integer(spark, sf_dir):
    """Each event adds 3 to one of 8 counters that start at 0."""
    counters = spark.range(8).select(F.col("id").alias("key"), F.lit(0).cast("bigint").alias("val"))
    updates = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("key"))
    return K.update(counters, updates, {"d": F.count("*")}, {"val": F.lit(0).cast("bigint")}, {"val": F.col("val") + F.col("u_d") * 3}).where("val > 0")


@R.query(f"SELECT o.key, o.val FROM ({OLD}) o WHERE o.key NOT IN (SELECT key FROM ({NEW}))")
def kv_remove(spark, sf_dir):
    return K.remove(_old(spark, sf_dir), _new(spark, sf_dir))


@R.query(f"SELECT key, val FROM ({OLD}) LIMIT 0")
def kv_clear(spark, sf_dir):
    return K.clear(_old(spark, sf_dir))


@R.query("""
WITH e AS (SELECT user_id AS key, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN 'remove' ELSE 'put' END AS op, event_id AS val, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT key, val FROM e WHERE r = 1 AND op = 'put'
""")
def kv_operation_log(spark, sf_dir):
    op = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), "remove").otherwise("put")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_id").alias("val"), "ts", F.col("event_id").alias("seq"))
    return K.replay(log, "op", ["ts", "seq"])


@R.query("SELECT key, max_by(val, val) AS val FROM (SELECT o_custkey AS key, o_orderkey AS val FROM orders) GROUP BY key")
def kv_bulk_load(spark, sf_dir):
    """Of rows that share a key the last one in order is loaded."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("val"))
    return T.load_keyed(rows, "val")


@R.query("""
WITH k AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
SELECT CAST(rn % 16 AS BIGINT) AS block_id, CAST((rn % 16) * (9223372036854775807 // 16) + rn // 16 AS BIGINT) AS key, id FROM k
""")
def kv_minted_keys(spark, sf_dir):
    """Keys dealt round-robin over 16 blocks of the key space."""
    return T.load_unkeyed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"], 16)


@R.query("SELECT CAST(least(1023, (o_orderkey * 1000003000003) // (9223372036854775807 // 1024)) AS BIGINT) AS block_id, count(*) AS items FROM orders GROUP BY 1")
def kv_ordered_blocks(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.lit(1000003000003)).alias("key"))
    return K.block_statistics(keys.select("key", T.ordered_block(F.col("key"), 1024).alias("block_id")))


@R.query("SELECT DISTINCT o_orderkey % 16 AS block_id, o_orderkey % 16 % 3 AS executor FROM orders")
def kv_placement(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("block_id")).distinct()
    return K.placement(blocks, 3)


@R.query("""
WITH c AS (SELECT label AS key, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS x FROM embeddings),
     s AS (SELECT key, p, round(sum(CAST(x AS DOUBLE)), 6) + 0.0 AS x FROM c GROUP BY key, p)
SELECT key, round(list_sum(list(x ORDER BY p)), 4) AS total, len(list(x)) AS size, round(list(x ORDER BY p)[3], 4) AS third FROM s GROUP BY key
""")
def kv_vector_add(spark, sf_dir):
    sums = K.add_vectors(table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), "embedding"), "embedding", digits=6)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return sums.select("key", F.round(total, 4).alias("total"), F.size("embedding").cast("bigint").alias("size"), F.round(F.get("embedding", F.lit(2)), 4).alias("third"))


@R.query("SELECT user_id AS key, string_agg(event_type, ',' ORDER BY ts, event_id) AS val FROM events GROUP BY user_id")
def kv_append_list(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type")
    return K.append(events, ["ts", "event_id"], "event_type").select("key", F.array_join("event_type", ",").alias("val"))


@R.query("SELECT user_id AS key, string_agg(event_type, '-' ORDER BY ts DESC, event_id DESC) || '-EMPTY' AS val FROM events GROUP BY user_id")
def kv_prefix_update(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("val"))
    return K.fold_ordered(events, ["ts", "event_id"], F.lit("EMPTY"), lambda old, u: F.concat(u, F.lit("-"), old), "val")


@R.query("""
WITH d AS (SELECT l_partkey AS part, l_suppkey AS supp, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS n FROM lineitem GROUP BY ALL)
SELECT part, supp, n FROM d WHERE n > 0
""")
def kv_count_increments(spark, sf_dir):
    deltas = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("bigint").alias("n"))
    return K.count_increments(deltas.where("false"), deltas, ["part", "supp"])


@R.query("""
WITH RECURSIVE g AS (
  SELECT l_orderkey AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS BIGINT) AS i, (l_quantity - 25) AS x FROM lineitem
), s(key, i, val) AS (
  SELECT o_orderkey, CAST(0 AS BIGINT), CAST(0.5 AS DOUBLE) FROM orders
  UNION ALL
  SELECT s.key, g.i, least(greatest(s.val - 0.0625 * g.x, 0.0), 1.0) FROM s JOIN g ON g.key = s.key AND g.i = s.i + 1
)
SELECT key, max_by(val, i) AS val FROM s GROUP BY key
""")
def kv_clipped_steps(spark, sf_dir):
    """Projected steps, clipped after each push."""
    start = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0.5).alias("val"))
    pushes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", (F.col("l_quantity") - 25).alias("val"))
    return K.clipped_steps(start, pushes, ["l_linenumber"], 0.0625, 1.0)


@R.query("""
WITH t AS (SELECT o_orderkey AS key, o_orderkey % 8 AS block_id, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS r,
  count(*) OVER (PARTITION BY o_orderkey % 8) AS n FROM orders)
SELECT block_id, key FROM t WHERE r <= floor(n * 0.25)
""")
def checkpoint_sampled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("block_id"), F.col("o_orderkey").alias("key"))
    return C.sample_blocks(rows, 0.25)


@R.query("SELECT o_orderkey AS key, o_totalprice AS val, CAST(o_orderkey % 8 AS INTEGER) AS block_id FROM orders")
def checkpoint_restored(spark, sf_dir):
    """A table written block by block with its configuration, and read back."""
    import uuid

    from ..sources.shared import shared_dir

    rows = _orders(spark, sf_dir).withColumn("block_id", (F.col("key") % 8).cast("int"))
    at = C.checkpoint(rows, f"{shared_dir(spark).rstrip('/')}/checkpoint-{uuid.uuid4().hex}", {"blocks": 8})
    return C.restore(spark, at)[0]


@R.query("SELECT l_suppkey AS supp, CAST(arg_min(l_linenumber, (-s, l_linenumber)) AS INTEGER) AS line, max(s) AS total FROM (SELECT l_suppkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def top1_argmax(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line")).agg(exact_sum("l_quantity").alias("total"))
    return K.top_of(sums, "supp", "line", "total")


QUERIES, ORACLE = R.queries, R.oracle
