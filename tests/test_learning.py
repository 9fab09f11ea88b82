import math

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import factors as N
from millrace.operators import regression as L
from millrace.operators import topics as D
from millrace.operators import trees as G


def test_softmax_at_zero_and_training(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = (x @ np.array([[2.0, 0, 1], [-1, 2, 0], [0, -1, -2]]).T).argmax(1)
    rows = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "label int, x array<double>")
    zero = [[0.0] * 3 for _ in range(3)]
    assert math.isclose(L.softmax_evaluation(rows, zero).first().loss, 200 * math.log(3), rel_tol=1e-9)
    g = {}
    for c in L.softmax_gradient(rows, zero).collect():
        g.setdefault(c.feature, []).append(c.g)
    assert all(abs(sum(v)) < 1e-9 for v in g.values())
    history = []
    w = L.fit_softmax(rows, 3, 3, epochs=20, step=1.0, history=history)
    epochs = {r.epoch: r.loss for r in L.evaluate_epochs(rows, L.weight_rows(spark, history)).collect()}
    assert len(epochs) == 20 and epochs[19] < epochs[0] and math.isclose(epochs[19], L.softmax_evaluation(rows, w).first().loss, rel_tol=1e-9)
    blocks = L.fit_softmax(rows.withColumn("b", F.col("label") * 0 + (F.hash("x") % 2)), 3, 3, epochs=3, step=0.5, block="b")
    assert L.softmax_evaluation(rows, blocks).first().accuracy > 0.8
    assert L.softmax_evaluation(rows, w).first().accuracy > 0.9


def test_lasso(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 2]
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    w = L.fit_lasso(rows, ["a", "b", "c"], "y", 1.0)
    assert abs(w[0] - 2) < 0.05 and abs(w[1]) < 0.01 and abs(w[2] + 1) < 0.05
    assert L.squared_loss(rows, ["a", "b", "c"], "y", w).first().loss < 1
    assert L.fit_lasso(rows.withColumn("b", F.lit(0.0)), ["a", "b", "c"], "y", 1.0)[1] == 0


def test_factorisation_lowers_the_loss(spark):
    cells = spark.range(200).select((F.col("id") % 20).alias("row"), (F.col("id") / 20).cast("long").alias("col"), ((F.col("id") % 20 + 1) * (F.floor(F.col("id") / 20) + 1) / 100).alias("val"))
    losses = [N.loss(N.with_errors(cells, *N.fit(cells, 2, k, 0.02))).first().loss for k in (0, 4)]
    assert losses[1] < losses[0]


def test_topics(spark):
    tokens = spark.createDataFrame([(d, p, ("a" if (d % 2) else "b") + str(p % 3)) for d in range(8) for p in range(12)], "doc_id long, pos int, word string")
    start = D.initial_topics(tokens, 2, 7)
    done = D.fit(tokens, 2, 6, 0.1, 0.01, 6, seed=7)
    assert done.count() == tokens.count()
    assert sum(r.n for r in D.topic_totals(done).collect()) == 96
    llh = lambda t: D.word_likelihood(t, 6, 0.01).first().llh
    assert llh(done) > llh(start)
    assert sum(r.n for r in D.changes(start, done).collect()) == 0
    own = {}
    for r in D.document_topics(start).collect():
        own.setdefault(r.doc_id, []).append(r.n)
    want = sum(sum(math.lgamma(n + 0.1) - math.lgamma(0.1) for n in v) + math.lgamma(0.2) - math.lgamma(sum(v) + 0.2) for v in own.values())
    assert math.isclose(D.document_likelihood(start, 2, 0.1).first().llh, want, rel_tol=1e-9)


def test_sweep_against_a_plain_sampler(spark, monkeypatch):
    """Token by token, with documents in runs, cut in blocks, repeated places, an empty and a null id."""
    r = np.random.default_rng(5)
    rows = [(d, p, f"w{int(r.integers(12)) ** 2 % 30}") for d in (0, 3, -3, 8, 11, 12) for p in range(int(r.integers(1, 70)))]
    rows = [(d, p, w) for d, p, w in rows if p % 13 != 7]  # gaps
    r.shuffle(rows)
    rows = [(int(d), int(p), str(w)) for d, p, w in rows]
    monkeypatch.setattr(D, "BLOCK", 20)
    monkeypatch.setattr(D, "SHARD", 10)
    tokens = D.initial_topics(spark.createDataFrame(rows, "doc_id long, pos int, word string"), 4, 1)
    start = sorted(tuple(x) for x in tokens.select("doc_id", "pos", "word", "topic").collect())
    words, totals, got = {}, np.zeros(4), D.sweep(tokens, 4, 0.1, 0.01, 30, 2)
    for _, _, w, t in start:
        words.setdefault(w, np.zeros(4))[t] += 1
        totals[t] += 1
    want = []
    for d in sorted({x[0] for x in start}):
        own = [x for x in start if x[0] == d]
        mine = np.bincount([x[3] for x in own], minlength=4).astype(float)
        draw = np.random.default_rng([2, abs(d)]).random(len(own))
        for (_, p, w, t), u in zip(own, draw):
            gone = np.eye(4)[t]
            mine -= gone
            odds = np.cumsum((mine + 0.1) * (words[w] - gone + 0.01) / (totals - gone + 30 * 0.01))
            t = int(np.searchsorted(odds, u * odds[-1], "right"))
            mine[t] += 1
            want.append((d, p, w, t))
    assert got.columns == ["doc_id", "pos", "word", "topic"] and sorted(tuple(x) for x in got.collect()) == want
    odd = D.initial_topics(spark.createDataFrame([(None, 0, "a"), (None, 1, "b"), (4, 0, "a"), (4, 0, "b"), (4, 1, None)], "doc_id long, pos int, word string"), 4, 1)
    assert sorted((str(x.doc_id), x.pos, x.word) for x in D.sweep(odd, 4, 0.1, 0.01, 30, 2).collect()) == [("4", 0, "a"), ("4", 0, "b"), ("None", 0, "a"), ("None", 1, "b")]
    assert D.sweep(tokens.where("false"), 4, 0.1, 0.01, 30, 2).count() == 0


def test_tree_split_and_leaves(spark):
    rows = spark.createDataFrame([(0, float(x), -2.0 * r) for x, r in zip((1, 2, 3, 4), (1, 1, -1, -1))], "node int, x double, g double")
    best = G.continuous_splits(G.value_sums(rows, ["node"]), ["node"]).first()
    assert (best.value, best.gain) == (2.0, 8.0)
    tree = G.grow(rows.select(F.array("x").alias("x"), "g"), [True], depth=1, leaf_min=1)
    assert tree.splits == {0: (0, 2.0)} and tree.leaves == {1: 1.0, 2: -1.0}
    flat = G.grow(rows.select(F.array("x").alias("x"), F.lit(0.0).alias("g")), [True])
    assert flat.splits == {} and flat.leaves == {0: 0.0}


def test_continuous_splits_against_plain_search(spark):
    r = np.random.default_rng(3)
    x, g = r.integers(0, 500, 800) / 7, r.normal(size=800)
    rows = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, g)], "node int, x double, g double")
    got = G.continuous_splits(G.value_sums(rows, ["node"]), ["node"]).first()
    part = lambda s, n: s * s / (2 * n)
    best = max((part(g[x <= v].sum(), (x <= v).sum()) + part(g[x > v].sum(), (x > v).sum()) - part(g.sum(), 800), v) for v in np.unique(x)[:-1])
    assert math.isclose(got.gain, best[0], rel_tol=1e-9) and got.value == best[1]


def test_many_categories(spark):
    rows = spark.createDataFrame([(0, float(c), 1.0 if c % 2 else -1.0) for c in range(14) for _ in range(3)], "node int, x double, g double")
    assert G.categorical_splits(G.value_sums(rows, ["node"]), ["node"]).first().left in ([float(c) for c in range(0, 14, 2)], [float(c) for c in range(1, 14, 2)])


def test_boosting(spark):
    rows = spark.range(120).select((F.col("id") % 3).cast("int").alias("label"), F.array((F.col("id") % 3 * 10 + F.col("id") % 2).cast("double"), (F.col("id") % 5).cast("double")).alias("x"))
    forests = G.boost(rows, [True, False], rounds=2, step=0.5, classes=3, depth=2)
    assert G.error_rate(G.predict(rows, forests, 0.5)).first().error == 0
