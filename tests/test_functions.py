import math

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import metrics as M
from millrace.operators import ranges as R
from millrace.plans import costs as C


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert one(spark, V.axpy(2, arr(1, 2), arr(10, 20))) == [12.0, 24.0]
    assert one(spark, V.dot(arr(1, 2, 3), arr(4, 5, 6))) == 32.0
    assert one(spark, V.cut(arr(0, 1, 2, 3), 1, 3)) == [1.0, 2.0]
    idx, val = F.array(F.lit(0), F.lit(2)), arr(5, 7)
    assert one(spark, V.densify(idx, val, 4)) == [5.0, 0.0, 7.0, 0.0]
    assert one(spark, V.sparse_dot(idx, val, arr(1, 1, 1, 1))) == 12.0
    assert one(spark, V.argmax(arr(1, 3, 3))) == 1
    p = one(spark, V.softmax(arr(0, 0, 0, 0)))
    assert np.allclose(p, 0.25) and max(one(spark, V.softmax(arr(1000, 0)))) == 1 - 1e-7
    assert [one(spark, V.soft_threshold(F.lit(x), F.lit(0.25))) for x in (3.0, -3.0, 0.2)] == [2.75, -2.75, 0.0]
    assert [r.x for r in spark.range(5).select(V.gray_code(F.col("id")).alias("x")).collect()] == [0, 1, 3, 2, 6]
    for x in (1e-3, 0.5, 1.0, 3.7, 1e6):
        assert math.isclose(one(spark, V.log_gamma(F.lit(x))), math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11)


def test_matrices(spark):
    a = np.arange(6.0).reshape(2, 3)
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(2) for j in range(3)], "i long, j int, v double")
    to = lambda df, shape: _dense(df, shape)
    assert (to(V.times(m, V.transpose(m)), (2, 2)) == a @ a.T).all()
    assert (to(V.columns(m, 1, 3), (2, 2)) == a[:, 1:]).all() and (to(V.rows(m, 1, 2), (1, 3)) == a[1:]).all()
    assert (to(V.beside(m, m, 3), (2, 6)) == np.hstack([a, a])).all() and (to(V.above(m, m, 2), (4, 3)) == np.vstack([a, a])).all()
    assert (to(V.cell_wise(m, m, "-"), (2, 3)) == 0).all() and (to(V.cell_wise(m, m, "*"), (2, 3)) == a * a).all()


def _dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_moving_average(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], "source string, t int, value double")
    assert abs(M.moving_average(rows, "source", [F.desc("t")], "value", 0.5).first().ema - 2.428571) < 1e-6
    assert M.moving_average(rows, "source", [F.desc("t")], "value", 0.5, 1).first().ema == 3.0
    assert M.after_warm_up(rows, "source", ["t"], 2).count() == 1
    assert M.timer(rows.where("false"), "value", "t").first().per_record == float("inf")


def test_ranges(spark):
    rows = spark.createDataFrame([("g", x) for x in (1, 2, 3, 7, 9, 10, 10)], "g string, x long")
    assert {(r.lo, r.hi) for r in R.dense_ranges(rows, "x", "g").collect()} == {(1, 3), (7, 7), (9, 10)}
    pair = spark.createDataFrame([(1, 10, 4, 6)], "a_lo long, a_hi long, b_lo long, b_hi long")
    assert [(r.lo, r.hi) for r in R.intersect(pair).collect()] == [(4, 6)]
    assert {(r.lo, r.hi) for r in R.complement(pair).collect()} == {(1, 3), (7, 10)}
    apart = spark.createDataFrame([(1, 3, 5, 6), (4, 5, 1, 9)], "a_lo long, a_hi long, b_lo long, b_hi long")
    assert {(r.lo, r.hi) for r in R.complement(apart).collect()} == {(1, 3)} and R.intersect(apart).count() == 1
    assert R.expand(R.dense_ranges(rows, "x", "g")).count() == 6


def test_costs(spark):
    e = spark.createDataFrame([(k, 2.0, 10.0) for k in range(3)], "id long, throughput double, bandwidth double")
    costs = {r.workers: r.cost for r in C.worker_costs(e, 5.0, 10).collect()}
    assert costs == {1: 10.0, 2: 7.5}
    assert C.cheapest(C.worker_costs(e, 5.0, 10)).first().workers == 2
    assert C.cheapest(C.worker_costs(e, 5.0, 10), current=1, threshold=0.5).first().workers == 1
    spread = C.rebalanced(spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, w double"), "w", 10)
    assert {(r.id, r.blocks) for r in spread.collect()} == {(1, 2), (2, 8)}
    moved = C.moves(spark.createDataFrame([(1, 6), (2, 4), (3, 0)], "id long, blocks long"), spark.createDataFrame([(1, 2), (2, 3), (3, 5)], "id long, blocks long"))
    assert {tuple(r) for r in moved.collect()} == {(1, 3, 4), (2, 3, 1)}
