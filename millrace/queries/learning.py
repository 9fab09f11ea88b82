"""Queries of model training and evaluation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import factors as N
from ..operators import regression as L
from ..operators import topics as D
from ..operators import trees as G
from .common import Registry, table

R = Registry()

CLASSES, DIM = 10, 64
WEIGHTS = [[((c * 31 + j * 17) % 100) / 1000 - 0.05 for j in range(DIM)] for c in range(CLASSES)]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "label", F.col("embedding").alias("x"))


SCORES = f"""
WITH w AS (SELECT c, j, ((c * 31 + j * 17) % 100) / 1000.0::DOUBLE - 0.05 AS w FROM range({CLASSES}) a(c), range({DIM}) b(j)),
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL),
z AS (SELECT vec_id, label, c, sum(w * x) AS z FROM e JOIN w USING (j) GROUP BY ALL),
m AS (SELECT *, z - max(z) OVER (PARTITION BY vec_id) AS d FROM z),
p AS (SELECT vec_id, label, c, least(greatest(exp(d) / sum(exp(d)) OVER (PARTITION BY vec_id), 1e-7), 1 - 1e-7) AS p FROM m)
"""


@R.query(SCORES + "SELECT CAST(c AS INTEGER) AS class, CAST(j AS INTEGER) AS feature, round(sum((p - CASE WHEN label = c THEN 1 ELSE 0 END) * x), 4) + 0.0 AS g FROM p JOIN e USING (vec_id, label) GROUP BY c, j")
def ml_softmax_gradient(spark, sf_dir):
    return L.softmax_gradient(_vectors(spark, sf_dir), WEIGHTS).select("class", "feature", (F.round("g", 4) + 0.0).alias("g"))


@R.query(SCORES + f", b AS (SELECT vec_id, arg_max(c, (p, -c)) AS guess FROM p GROUP BY vec_id), l AS (SELECT sum(-ln(p)) AS loss, count(*) AS n FROM p WHERE c = label) SELECT n, round(loss, 4) AS loss, round(loss + (SELECT 0.005 / 2 * sum(w * w) / {CLASSES} FROM w), 4) AS penalised, (SELECT round(avg(CASE WHEN b.guess = e.label THEN 1.0 ELSE 0.0 END), 6) FROM b JOIN (SELECT vec_id, label FROM embeddings) e USING (vec_id)) AS accuracy FROM l")
def ml_softmax_evaluation(spark, sf_dir):
    out = L.softmax_evaluation(_vectors(spark, sf_dir), WEIGHTS, 0.005)
    return out.select("n", F.round("loss", 4).alias("loss"), F.round("penalised", 4).alias("penalised"), F.round("accuracy", 6).alias("accuracy"))


@R.query()
def ml_softmax_training(spark, sf_dir):
    """Five synchronous epochs and the evaluation of what they give."""
    rows = _vectors(spark, sf_dir)
    w = L.fit_softmax(rows, CLASSES, DIM, epochs=5, step=1.0, penalty=0.005, decay=0.9, decay_every=5)
    return L.softmax_evaluation(rows, w, 0.005)


@R.query(SCORES + "SELECT CAST(0 AS INTEGER) AS epoch, count(*) AS n, round(sum(-ln(p)), 4) AS loss FROM p WHERE c = label")
def ml_softmax_epochs(spark, sf_dir):
    """A saved model's loss, as offline evaluation gives it for each epoch."""
    out = L.evaluate_epochs(_vectors(spark, sf_dir), L.weight_rows(spark, [WEIGHTS]))
    return out.select("epoch", "n", F.round("loss", 4).alias("loss"))


FEATURES, TARGET = ["l_quantity", "l_discount", "l_tax"], "price"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))


SUMS = "SELECT " + ", ".join(f"sum({a} * {b}) AS s{i}{j}" for i, a in enumerate(FEATURES) for j, b in enumerate([*FEATURES, "l_extendedprice / 1000"]) if j >= i) + " FROM lineitem"


def _pass_sql(k: int) -> str:
    """One coordinate's step: w0, w1, w2 so far are columns."""
    full = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    x = f"(({full(k, 3)} - " + " - ".join(f"{full(k, j)} * w{j}" for j in range(3) if j != k) + f") / {full(k, k)})"
    b = f"(50.0 / {full(k, k)})"
    return f"CASE WHEN abs{x} <= {b} THEN 0.0 WHEN {x} > 0 THEN {x} - {b} ELSE {x} + {b} END"


def _lasso_sql(passes: int) -> str:
    s = f"WITH t0 AS (SELECT *, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM ({SUMS}))"
    n = 0
    for _ in range(passes):
        for k in range(3):
            s += f", t{n + 1} AS (SELECT * REPLACE ({_pass_sql(k)} AS w{k}) FROM t{n})"
            n += 1
    return s + f" SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, round(unnest([w0, w1, w2]), 4) AS weight FROM t{n}"


@R.query(_lasso_sql(3))
def ml_lasso(spark, sf_dir):
    """Three passes of coordinate descent on one pass's sums of products."""
    w = L.fit_lasso(_priced(spark, sf_dir), FEATURES, TARGET, 50.0, passes=3)
    return spark.createDataFrame([(f, round(x, 4)) for f, x in zip(FEATURES, w)], "feature string, weight double")


@R.query("SELECT count(*) AS n, round(sum(pow(l_extendedprice / 1000 - (0.8 * l_quantity + 2 * l_discount - l_tax), 2)), 2) AS loss FROM lineitem")
def ml_lasso_loss(spark, sf_dir):
    return L.squared_loss(_priced(spark, sf_dir), FEATURES, TARGET, [0.8, 2.0, -1.0]).select("n", F.round("loss", 2).alias("loss"))


@R.query("SELECT i, j, round(v, 2) AS v FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum({a} * {b}) AS v FROM lineitem" for i, a in enumerate(FEATURES) for j, b in enumerate([*FEATURES, "l_extendedprice / 1000"]) if j >= i) + ")")
def ml_normal_sums(spark, sf_dir):
    return L.normal_sums(_priced(spark, sf_dir), FEATURES, TARGET).select("i", "j", F.round("v", 2).alias("v"))


RANK = 3
CELLS = "SELECT user_id AS row, length(event_type) AS col, CAST(count(*) AS DOUBLE) AS val FROM events GROUP BY ALL"


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("row"), F.length("event_type").cast("bigint").alias("col")).agg(F.count("*").cast("double").alias("val"))


def _factor(ids, a: int):
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(RANK - 1)), lambda k: ((F.col("id") * a + k * 7) % 10) / 5.0).alias("f"))


ERRORS = f"""
WITH d AS ({CELLS}), k AS (SELECT unnest(range({RANK})) AS k),
f AS (SELECT row, col, val, k, ((row * 3 + k * 7) % 10) / 5.0 AS l, ((col * 11 + k * 7) % 10) / 5.0 AS r FROM d, k),
e AS (SELECT row, col, sum(l * r) - any_value(val) AS e FROM f GROUP BY row, col)
"""


def _errors(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    left = _factor(cells.select(F.col("row").alias("id")).distinct(), 3)
    right = _factor(cells.select(F.col("col").alias("id")).distinct(), 11)
    return N.with_errors(cells, left, right), left


@R.query(ERRORS + "SELECT count(*) AS n, round(sum(e * e), 4) AS loss FROM e")
def ml_factor_loss(spark, sf_dir):
    return N.loss(_errors(spark, sf_dir)[0]).select("n", F.round("loss", 4).alias("loss"))


@R.query(ERRORS + "SELECT row AS id, CAST(k AS INTEGER) AS k, round(sum(2 * e * r) + 2 * 0.1 * any_value(l), 4) + 0.0 AS g FROM e JOIN f USING (row, col) GROUP BY row, k")
def ml_factor_gradient(spark, sf_dir):
    errors, left = _errors(spark, sf_dir)
    return N.gradient(errors, "row", "r", left, 0.1).select("id", "k", (F.round("g", 4) + 0.0).alias("g"))


@R.query(ERRORS + ", g AS (SELECT row AS id, k, sum(2 * e * r) + 2 * 0.1 * any_value(l) AS g, any_value(l) AS l FROM e JOIN f USING (row, col) GROUP BY row, k) SELECT id, round(sum(least(greatest(l - 0.01 * g, 0.0), 5.0)), 4) AS total FROM g GROUP BY id")
def ml_factor_step(spark, sf_dir):
    errors, left = _errors(spark, sf_dir)
    new = N.stepped(left, N.gradient(errors, "row", "r", left, 0.1), 0.01, 5.0)
    return new.select("id", F.round(V.total(F.col("f")), 4).alias("total"))


@R.query()
def ml_factor_training(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return N.loss(N.with_errors(cells, *N.fit(cells, 3, 3, 0.0005, 0.01)))


TOPICS, ALPHA, BETA = 10, 0.1, 0.01


def _tokens(spark, sf_dir):
    """The documents' words by position, each with a topic by rule."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.withColumn("topic", ((F.length("word") + F.col("pos")) % TOPICS).cast("int"))


TOKENS = "WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM s), t AS (SELECT doc_id, word, CAST((length(word) + pos) % 10 AS INTEGER) AS topic FROM u) "


@R.query(TOKENS + "SELECT word, topic, count(*) AS n FROM t GROUP BY word, topic")
def ml_topic_counts(spark, sf_dir):
    return D.word_topics(_tokens(spark, sf_dir))


@R.query(TOKENS + "SELECT topic, count(*) AS n FROM t GROUP BY topic")
def ml_topic_totals(spark, sf_dir):
    return D.topic_totals(_tokens(spark, sf_dir))


@R.query(TOKENS + ", c AS (SELECT doc_id, topic, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(lgamma(n + 0.1) - lgamma(0.1)) AS s, sum(n) AS n FROM c GROUP BY doc_id) SELECT round(sum(s + lgamma(1.0) - lgamma(n + 1.0)), 1) AS llh FROM d")
def ml_topic_document_likelihood(spark, sf_dir):
    return D.document_likelihood(_tokens(spark, sf_dir), TOPICS, ALPHA).select(F.round("llh", 1).alias("llh"))


@R.query(TOKENS + ", c AS (SELECT word, topic, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT topic, sum(lgamma(n + 0.01) - lgamma(0.01)) AS s, sum(n) AS n FROM c GROUP BY topic) SELECT round(sum(s + lgamma(500.0) - lgamma(n + 500.0)), 1) AS llh FROM d")
def ml_topic_word_likelihood(spark, sf_dir):
    return D.word_likelihood(_tokens(spark, sf_dir), 50_000, BETA).select(F.round("llh", 1).alias("llh"))


@R.query(TOKENS + ", d AS (SELECT word, topic, 1 AS n FROM t UNION ALL SELECT word, (topic + length(word) % 2) % 10, -1 FROM t) SELECT word, topic, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL HAVING sum(n) <> 0")
def ml_topic_changes(spark, sf_dir):
    after = _tokens(spark, sf_dir)
    before = after.withColumn("topic", ((F.col("topic") + F.length("word") % 2) % TOPICS).cast("int"))
    return D.changes(before, after)


@R.query()
def ml_topic_sweep(spark, sf_dir):
    """One sweep of the sampler over all documents' tokens, as counts by topic."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("word"))
    tokens = words.agg(F.sum(F.greatest(F.size("word"), F.lit(0)))).first()[0] or 0
    done = D.sweep_documents(D.documents(words, TOPICS, 1), tokens, TOPICS, ALPHA, BETA, 50_000, 2)
    return D.topic_totals(done.select(F.explode("topic").alias("topic")))


def _graded(spark, sf_dir):
    """Gradients of order lines: g is -2 (tax - 0.04)."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("node"), "l_quantity", "l_suppkey", "l_returnflag", (-2 * (F.col("l_tax") - 0.04)).alias("g"))


@R.query("""
WITH s AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS node, l_quantity AS x, count(*) AS n, sum(-2 * (l_tax - 0.04)) AS g FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(n) OVER l AS nl, sum(g) OVER l AS gl, sum(n) OVER a AS nn, sum(g) OVER a AS gg FROM s
  WINDOW l AS (PARTITION BY node ORDER BY x), a AS (PARTITION BY node)),
q AS (SELECT node, x, round(gl * gl / (2 * nl + 1) + (gg - gl) * (gg - gl) / (2 * (nn - nl) + 1) - gg * gg / (2 * nn + 1), 6) AS gain FROM w WHERE nl < nn)
SELECT node, arg_max(x, (gain, -x)) AS value, max(gain) AS gain FROM q GROUP BY node
""")
def ml_tree_continuous_split(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumnRenamed("l_quantity", "x")
    return G.continuous_splits(G.value_sums(rows, ["node"]), ["node"], ridge=1.0, digits=6)


@R.query("SELECT CAST(l_linenumber % 3 AS INTEGER) AS node, l_returnflag AS x, count(*) AS n, round(sum(-2 * (l_tax - 0.04)), 6) AS g FROM lineitem GROUP BY ALL")
def ml_tree_histogram(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumnRenamed("l_returnflag", "x")
    return G.value_sums(rows, ["node"]).select("node", "x", "n", F.round("g", 6).alias("g"))


@R.query("""
WITH s AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS node, ascii(l_returnflag) AS x, count(*) AS n, sum(-2 * (l_tax - 0.04)) AS g FROM lineitem GROUP BY ALL),
t AS (SELECT node, sum(n) AS nn, sum(g) AS gg, min(x) AS lo, max(x) AS hi FROM s GROUP BY node),
o AS (SELECT s.node, s.x AS alone, s.n AS nl, s.g AS gl, nn, gg FROM s JOIN t ON s.node = t.node)
SELECT node, round(max(gl * gl / (2 * nl + 1) + (gg - gl) * (gg - gl) / (2 * (nn - nl) + 1) - gg * gg / (2 * nn + 1)), 6) AS gain FROM o GROUP BY node
""")
def ml_tree_categorical_split(spark, sf_dir):
    """Three categories: every split has one of them alone."""
    rows = _graded(spark, sf_dir).withColumn("x", F.ascii("l_returnflag").cast("double"))
    return G.categorical_splits(G.value_sums(rows, ["node"]), ["node"], ridge=1.0).select("node", F.round("gain", 6).alias("gain"))


@R.query("SELECT CAST(l_linenumber % 3 AS INTEGER) AS node, round(-sum(-2 * (l_tax - 0.04)) / (2 * count(*) + 1), 8) AS value FROM lineitem GROUP BY 1")
def ml_tree_leaves(spark, sf_dir):
    return _graded(spark, sf_dir).groupBy("node").agg(F.round(G.leaf_value(F.sum("g"), F.count("*"), 1.0), 8).alias("value"))


TREE = G.Tree({0: (0, 24.0), 1: (1, [0.0, 2.0])}, {2: 3.0, 3: 1.0, 4: 2.0})


@R.query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(sum(CASE WHEN l_quantity <= 24 THEN CASE WHEN l_suppkey % 4 IN (0, 2) THEN 0.5 ELSE 1.0 END ELSE 1.5 END) AS DOUBLE) AS guess FROM lineitem GROUP BY ALL")
def ml_tree_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array(F.col("l_quantity"), (F.col("l_suppkey") % 4).cast("double")).alias("x"))
    return G.predict(rows, [[TREE]], 0.5).groupBy("id", "line").agg(F.sum("guess").alias("guess"))


@R.query()
def ml_tree_training(spark, sf_dir):
    """Two boosted trees of depth 2 on the line's price, and their squared error."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select((F.col("l_extendedprice") / 1000).alias("label"), F.array(F.col("l_quantity"), F.ascii("l_returnflag").cast("double")).alias("x"))
    forest = G.boost(rows, [True, False], rounds=2, step=0.5, depth=2)
    return G.predict(rows, forest, 0.5).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("guess") - F.col("label"), 2)).alias("loss"))


QUERIES, ORACLE = R.queries, R.oracle
