"""Queries of vector and matrix functions over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from .common import Registry, table

R = Registry()
DIM = 64
#: A fixed dense vector.
FIXED = [((k * 31) % 17 - 8) / 8 for k in range(DIM)]
FIXED_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in FIXED) + "]"
E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def _fixed():
    return F.array(*[F.lit(x) for x in FIXED])


def _summed(rows, vector):
    """vec_id, the vector's sum and its last element, rounded."""
    return rows.select("vec_id", F.round(V.total(vector), 6).alias("total"), F.round(F.element_at(vector, -1), 6).alias("last"))


def _summed_sql(expr: str) -> str:
    return f"SELECT vec_id, round(list_sum(v), 6) AS total, round(v[len(v)], 6) AS last FROM (SELECT vec_id, {expr} AS v FROM embeddings)"


@R.query(f"SELECT vec_id, round(list_inner_product({E}, {FIXED_SQL}), 6) AS dot FROM embeddings")
def la_dot(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.round(V.dot(F.col("embedding"), _fixed()), 6).alias("dot"))


@R.query(f"SELECT vec_id, round(sqrt(list_inner_product({E}, {E})), 6) AS norm FROM embeddings")
def la_norm(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@R.query(_summed_sql(f"list_transform(list_zip({E}, {FIXED_SQL}), lambda p: p[1] + 0.5 * p[2])"))
def la_axpy(spark, sf_dir):
    return _summed(_rows(spark, sf_dir), V.axpy(0.5, _fixed(), F.col("embedding")))


@R.query(_summed_sql(f"list_transform({E}, lambda x: x * 2.5)"))
def la_scale(spark, sf_dir):
    return _summed(_rows(spark, sf_dir), V.scale(F.col("embedding"), 2.5))


@R.query(_summed_sql(f"list_transform({E}, lambda x: (x + 1.5) / 4)"))
def la_add_divide(spark, sf_dir):
    return _summed(_rows(spark, sf_dir), V.divide(V.add_scalar(F.col("embedding"), 1.5), 4))


@R.query(_summed_sql(f"list_transform(list_zip({E}, {FIXED_SQL}), lambda p: (p[1] + p[2]) * (p[1] - p[2]))"))
def la_add_subtract_multiply(spark, sf_dir):
    e = F.col("embedding")
    return _summed(_rows(spark, sf_dir), V.multiply(V.add(e, _fixed()), V.subtract(e, _fixed())))


@R.query(_summed_sql(f"{E}[9:16]"))
def la_slice(spark, sf_dir):
    return _summed(_rows(spark, sf_dir), V.cut(V.scale(F.col("embedding"), 1), 8, 16))


@R.query(f"SELECT vec_id, round({E}[3] * 2 + {E}[60] * -1.5, 6) AS dot, CAST(2 AS INTEGER) AS active FROM embeddings")
def la_sparse(spark, sf_dir):
    """A sparse vector against dense ones, and as a dense one."""
    idx, val = F.array(F.lit(2), F.lit(59)), F.array(F.lit(2.0), F.lit(-1.5))
    return _rows(spark, sf_dir).select("vec_id", F.round(V.sparse_dot(idx, val, F.col("embedding")), 6).alias("dot"), V.active_size(V.densify(idx, val, DIM)).alias("active"))


@R.query("SELECT i, j, round(v, 4) + 0.0 AS v FROM (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM " + " JOIN ".join(f"(SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, vec_id AS r, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) {n}" for n in "ab") + " ON a.r = b.r GROUP BY a.i, b.i)")
def la_gram(spark, sf_dir):
    return V.gram(_rows(spark, sf_dir), "embedding", DIM).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


LONG = "(SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id < 100)"


def _long(spark, sf_dir):
    return V.to_rows(_rows(spark, sf_dir).where("vec_id < 100"), "vec_id", "embedding")


@R.query(f"SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM {LONG} a JOIN {LONG} b ON a.j = b.j GROUP BY a.i, b.i")
def la_matrix_product(spark, sf_dir):
    m = _long(spark, sf_dir)
    return V.times(m, V.transpose(m)).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


@R.query(f"SELECT i, round(sum(v * (j + 1)), 4) AS v FROM {LONG} GROUP BY i")
def la_matrix_vector(spark, sf_dir):
    x = spark.range(DIM).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return V.times_vector(_long(spark, sf_dir), x).select("i", F.round("v", 4).alias("v"))


@R.query(f"SELECT a.i, a.j, round(a.v + coalesce(b.v, 0) - a.v * a.v, 6) + 0.0 AS v FROM {LONG} a LEFT JOIN (SELECT i, j - 32 AS j, v FROM {LONG} WHERE j >= 32) b ON a.i = b.i AND a.j = b.j")
def la_matrix_cells(spark, sf_dir):
    """m plus its right half moved left, less the square of each cell."""
    m = _long(spark, sf_dir)
    return V.cell_wise(V.cell_wise(m, V.columns(m, 32, 64), "+"), V.cell_wise(m, m, "*"), "-").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@R.query(f"SELECT i, CAST(j AS INTEGER) AS j, v FROM (SELECT i, j, v FROM {LONG} WHERE i < 10 UNION ALL SELECT i + 10, j, v FROM {LONG} WHERE i < 10 UNION ALL SELECT i, j + 64, v FROM {LONG} WHERE i < 10)")
def la_matrix_stack(spark, sf_dir):
    m = V.rows(_long(spark, sf_dir), 0, 10)
    return V.above(V.beside(m, m, DIM), m, 10).select("i", F.col("j").cast("int").alias("j"), "v")


# The same over all vectors. A product with the own transpose is quadratic, so the product is with a fixed DIM x WIDE matrix.
LONG_ALL = LONG.replace(" WHERE vec_id < 100", "")
WIDE = 4
WEIGHTS = f"(SELECT CAST(j AS INTEGER) AS j, CAST(c AS INTEGER) AS c, ((j * 31 + c * 7) % 17 - 8) / 8.0::DOUBLE AS w FROM range({DIM}) a(j), range({WIDE}) b(c))"
HEIGHT = "(SELECT max(vec_id) + 1 FROM embeddings)"


def _long_all(spark, sf_dir):
    return V.to_rows(_rows(spark, sf_dir), "vec_id", "embedding")


@R.query(f"SELECT i, c AS j, round(sum(v * w), 4) + 0.0 AS v FROM {LONG_ALL} JOIN {WEIGHTS} USING (j) GROUP BY i, c")
def la_matrix_product_all(spark, sf_dir):
    at = spark.range(DIM * WIDE).select((F.col("id") / WIDE).cast("int").alias("i"), (F.col("id") % WIDE).cast("int").alias("j"))
    weights = at.select("i", "j", (((F.col("i") * 31 + F.col("j") * 7) % 17 - 8) / F.lit(8.0)).alias("v"))
    return V.times(_long_all(spark, sf_dir), weights).select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


@R.query(f"SELECT i, round(sum(v * (j + 1)), 4) AS v FROM {LONG_ALL} GROUP BY i")
def la_matrix_vector_all(spark, sf_dir):
    x = spark.range(DIM).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return V.times_vector(_long_all(spark, sf_dir), x).select("i", F.round("v", 4).alias("v"))


@R.query(f"SELECT a.i, a.j, round(a.v + coalesce(b.v, 0) - a.v * a.v, 6) + 0.0 AS v FROM {LONG_ALL} a LEFT JOIN (SELECT i, j - 32 AS j, v FROM {LONG_ALL} WHERE j >= 32) b ON a.i = b.i AND a.j = b.j")
def la_matrix_cells_all(spark, sf_dir):
    m = _long_all(spark, sf_dir)
    return V.cell_wise(V.cell_wise(m, V.columns(m, 32, 64), "+"), V.cell_wise(m, m, "*"), "-").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@R.query(f"SELECT i, CAST(j AS INTEGER) AS j, v FROM (SELECT i, j, v FROM {LONG_ALL} UNION ALL SELECT i + {HEIGHT}, j, v FROM {LONG_ALL} UNION ALL SELECT i, j + 64, v FROM {LONG_ALL})")
def la_matrix_stack_all(spark, sf_dir):
    m = _long_all(spark, sf_dir)
    height = (_rows(spark, sf_dir).agg(F.max("vec_id")).first()[0] or 0) + 1
    return V.above(V.beside(m, m, DIM), m, height).select("i", F.col("j").cast("int").alias("j"), "v")


@R.query(f"WITH p AS (SELECT vec_id, label, {E} AS e FROM embeddings), z AS (SELECT *, list_max(e) AS top FROM p), s AS (SELECT *, list_sum(list_transform(e, lambda x: exp(x - top))) AS s FROM z) SELECT vec_id, round(least(greatest(exp(e[1] - top) / s, 1e-7), 1 - 1e-7), 6) AS p0, CAST(list_position(e, top) - 1 AS INTEGER) AS best FROM s")
def la_softmax(spark, sf_dir):
    p = V.softmax(V.scale(F.col("embedding"), 1))
    return _rows(spark, sf_dir).select("vec_id", F.round(F.get(p, F.lit(0)), 6).alias("p0"), V.argmax(F.col("embedding")).alias("best"))


@R.query("SELECT c_custkey AS id, CASE WHEN abs(c_acctbal) <= 100.0 / 3 THEN 0.0 WHEN c_acctbal > 0 THEN round(c_acctbal - 100.0 / 3, 6) ELSE round(c_acctbal + 100.0 / 3, 6) END AS v FROM customer")
def fn_soft_threshold(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(V.soft_threshold(F.col("c_acctbal"), F.lit(100.0) / 3), 6).alias("v"))


@R.query("SELECT o_orderkey AS id, xor(o_orderkey, o_orderkey >> 1) AS code FROM orders")
def fn_gray_code(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.gray_code(F.col("o_orderkey")).alias("code"))


@R.query("SELECT o_orderkey AS id, round(lgamma(o_totalprice / 1000 + 0.01), 6) AS v FROM orders")
def fn_log_gamma(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(V.log_gamma(F.col("o_totalprice") / 1000 + 0.01), 6).alias("v"))


@R.query("SELECT c_custkey AS id, abs(c_acctbal - round(c_acctbal)) < 1e-2 AS whole FROM customer")
def fn_near_zero(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.near_zero(F.col("c_acctbal") - F.round("c_acctbal"), 1e-2).alias("whole"))


QUERIES, ORACLE = R.queries, R.oracle
