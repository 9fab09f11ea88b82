from pyspark.sql import functions as F

from millrace.operators import keyed as K
from millrace.sources import checkpoint as C
from millrace.sources import text as T


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, val string")


def as_dict(df):
    return {r.key: r.val for r in df.collect()}


def test_put_get_remove(spark):
    old, new = table(spark, [(1, "a"), (2, "b")]), table(spark, [(2, "B"), (3, "c")])
    assert as_dict(K.put(old, new)) == {1: "a", 2: "B", 3: "c"}
    assert as_dict(K.put_if_absent(old, new)) == {1: "a", 2: "b", 3: "c"}
    assert as_dict(K.previous(old, new)) == {2: "b"}
    assert as_dict(K.get(old, 2)) == {2: "b"} and as_dict(K.get(old, 9)) == {}
    assert as_dict(K.multi_get(old, new)) == {2: "b"}
    assert as_dict(K.remove(K.put(old, new), new)) == {1: "a"}
    assert K.clear(old).columns == ["key", "val"] and K.clear(old).isEmpty()


def test_get_or_init_keeps_null_values(spark):
    old = table(spark, [(1, None)])
    got, after = K.get_or_init(old, table(spark, [(1, ""), (7, ""), (7, "")]), {"val": F.concat(F.lit("INIT_"), F.col("key").cast("string"))})
    assert as_dict(got) == {1: None, 7: "INIT_7"} and after.count() == 2


def test_update_folds_and_initialises(spark):
    counters = spark.createDataFrame([(k, 0) for k in range(8)], "key long, val long")
    updates = spark.range(2 * 128).select((F.col("id") % 8).alias("key"))
    out = K.update(counters, updates, {"n": F.count("*")}, {"val": F.lit(0)}, {"val": F.col("val") + F.col("u_n")})
    assert {r.val for r in out.collect()} == {32}
    out = K.update(counters.where("key = 0"), spark.range(2).select((F.col("id") + 5).alias("key")), {"n": F.count("*")}, {"val": F.lit(10)}, {"val": F.col("val") + F.col("u_n")})
    assert {(r.key, r.val) for r in out.collect()} == {(0, 0), (5, 11), (6, 11)}


def test_ordered_folds(spark):
    log = spark.createDataFrame([(5, 1, "Update-"), (5, 2, "x")], "key long, seq int, val string")
    assert as_dict(K.fold_ordered(log.where("seq = 1"), ["seq"], F.lit("5"), lambda old, u: F.concat(u, old), "val")) == {5: "Update-5"}
    assert as_dict(K.append(log, ["seq"], "val")) == {5: ["Update-", "x"]}


def test_vectors_add_up(spark):
    pushes = spark.createDataFrame([(1, [0.5] * 5)] * 6, "key long, v array<float>")
    assert K.add_vectors(pushes, "v").first().v == [3.0] * 5


def test_counts_stop_at_zero(spark):
    have = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "w int, t int, n long")
    delta = spark.createDataFrame([(1, 0, -5), (1, 1, 1), (2, 0, 3)], "w int, t int, n long")
    assert {tuple(r) for r in K.count_increments(have, delta, ["w", "t"]).collect()} == {(1, 1, 2), (2, 0, 3)}


def test_blocks(spark):
    assert T.block_size(4) == 2305843009213693951
    keys = spark.createDataFrame([(0,), (2305843009213693951,), (9223372036854775807,)], "key long")
    assert [r.b for r in keys.select(T.ordered_block(F.col("key"), 4).alias("b")).collect()] == [0, 1, 3]
    minted = T.load_unkeyed(spark.range(10), ["id"], 4)
    assert sorted(r.items for r in K.block_statistics(minted).collect()) == [2, 2, 3, 3]
    assert minted.select("key").distinct().count() == 10
    assert T.load_unkeyed(spark.range(0), ["id"], 4).count() == 0


def test_load_keyed_takes_the_last(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "key long, val string, seq int")
    assert as_dict(T.load_keyed(rows, "seq")) == {1: "b", 2: "c"}


def test_checkpoint_round_trip(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("key"), (F.col("id") % 4).alias("block_id"), F.lit("v").alias("val"))
    at = C.checkpoint(rows, f"file://{tmp_path}/c", {"blocks": 4})
    back, config = C.restore(spark, at)
    assert config == {"blocks": 4} and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert C.sample_blocks(rows, 0.25).groupBy("block_id").count().collect()[0]["count"] == 2


def test_replay(spark):
    log = spark.createDataFrame([(1, "put", "a", 1), (1, "remove", None, 2), (2, "put", "b", 1), (2, "put", "c", 2)], "key long, op string, val string, seq int")
    assert as_dict(K.replay(log, "op", ["seq"])) == {2: "c"}


def test_clipped_steps_in_chunks(spark, monkeypatch):
    import random

    monkeypatch.setattr(K, "CHUNK", 3)
    r = random.Random(1)
    pushes = [(k, t, r.randint(-8, 8) / 4) for k in range(3) for t in range(20 * k)]
    start = spark.createDataFrame([(k, 0.5) for k in range(4)], "key long, val double")
    got = as_dict(K.clipped_steps(start, spark.createDataFrame(pushes, "key long, t int, val double"), ["t"], 0.5, 1.0))
    want = dict.fromkeys(range(4), 0.5)
    for k, _, g in pushes:
        want[k] = min(max(want[k] - 0.5 * g, 0.0), 1.0)
    assert got == want
