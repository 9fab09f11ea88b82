"""Dense vectors as array columns, sparse ones as index and value arrays, matrices as rows (i, j, v).

All but gram are column expressions or joins and aggregates, so they stay in generated code; arithmetic is in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Array = Column


def _d(x: Column) -> Column:
    return x.cast("double")


def add_scalar(a: Array, c: float) -> Array:
    return F.transform(a, lambda x: _d(x) + F.lit(float(c)))


def scale(a: Array, c: float) -> Array:
    return F.transform(a, lambda x: _d(x) * F.lit(float(c)))


def divide(a: Array, c: float) -> Array:
    return F.transform(a, lambda x: _d(x) / F.lit(float(c)))


def add(a: Array, b: Array) -> Array:
    return F.zip_with(a, b, lambda x, y: _d(x) + _d(y))


def subtract(a: Array, b: Array) -> Array:
    return F.zip_with(a, b, lambda x, y: _d(x) - _d(y))


def multiply(a: Array, b: Array) -> Array:
    return F.zip_with(a, b, lambda x, y: _d(x) * _d(y))


def axpy(c: float, x: Array, y: Array) -> Array:
    """y + c * x."""
    return F.zip_with(y, x, lambda p, q: _d(p) + F.lit(float(c)) * _d(q))


def total(a: Array) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x))


def dot(a: Array, b: Array) -> Column:
    return total(multiply(a, b))


def norm(a: Array) -> Column:
    return F.sqrt(dot(a, a))


def cut(a: Array, start: int, end: int) -> Array:
    """Elements from start (from 0) to before end."""
    return F.slice(a, start + 1, end - start)


def zeros(n: int) -> Array:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Array:
    return F.array_repeat(F.lit(1.0), n)


def sparse_dot(idx: Column, val: Column, dense: Array) -> Column:
    """Of a sparse vector with a dense one; indices from 0."""
    return F.aggregate(F.zip_with(idx, val, lambda i, v: _d(v) * _d(F.get(dense, i))), F.lit(0.0), lambda s, x: s + x)


def densify(idx: Column, val: Column, n: int) -> Array:
    cells = F.map_from_arrays(idx, val)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(_d(F.try_element_at(cells, i)), F.lit(0.0)))


def active_size(a: Array) -> Column:
    return F.size(F.filter(a, lambda x: x != 0))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's argument is bound, a repeated expression in one is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(z: Array, least: float = 1e-7) -> Array:
    """Probabilities by log-sum-exp, kept within [least, 1 - least]."""

    def of(z: Array) -> Array:
        exps = lambda top: F.transform(z, lambda x: F.exp(x - top))
        share = lambda e: let(total(e), lambda s: F.transform(e, lambda x: F.least(F.greatest(x / s, F.lit(least)), F.lit(1 - least))))
        return let(let(F.array_max(z), exps), share)

    return let(z, of)


def soft_threshold(x: Column, bound: Column) -> Column:
    """0 within the bound, else x moved towards 0 by it."""
    return F.when(F.abs(x) <= bound, F.lit(0.0)).when(x > 0, x - bound).otherwise(x + bound)


def near_zero(x: Column, within: float = 1e-9) -> Column:
    return F.abs(x) < within


def gray_code(i: Column) -> Column:
    return i.bitwiseXOR(F.shiftright(i, 1))


def argmax(a: Array) -> Column:
    """Position from 0 of the greatest element, the first of equal ones."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


LANCZOS_SHIFT = 8


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, less the logarithm of the product it was shifted by."""
    y = x + LANCZOS_SHIFT
    product = F.lit(1.0)
    for k in range(LANCZOS_SHIFT):
        product = product * (x + k)
    inv = 1 / y
    inv2 = inv * inv
    series = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * F.lit(1 / 1188)))))
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.log(product)


# Matrices as rows (i, j, v).


def to_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, v) of vectors as the rows of a matrix."""
    return vectors.select(F.col(key).alias("i"), F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """a b: a join on the inner index and a sum of products."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(right, a["j"] == right["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def gram(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """(i, j, v) of the sum of x x^T over all rows x of n elements: one pass, no join.

    Each partition adds up its batches as matrix products, so n * n sums a partition are shuffled; as expressions the
    same takes n * n rows for every row.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy()).astype(float)
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    whole = rows.where(F.size(vector) == n).select(F.col(vector).alias("x"))
    return whole.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def cell_wise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """a + b, a - b (missing cells are 0), or a * b."""
    right = b.select("i", "j", F.col("v").alias("_v"))
    if op == "*":
        return a.join(right, ["i", "j"]).select("i", "j", (F.col("v") * F.col("_v")).alias("v"))
    x, y = F.coalesce("v", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))
    return a.join(right, ["i", "j"], "full_outer").select("i", "j", (x + y if op == "+" else x - y).alias("v"))


def columns(m: DataFrame, start: int, end: int) -> DataFrame:
    """Columns from start to before end, numbered anew from 0."""
    return m.where((F.col("j") >= start) & (F.col("j") < end)).withColumn("j", F.col("j") - start)


def rows(m: DataFrame, start: int, end: int) -> DataFrame:
    return transpose(columns(transpose(m), start, end))


def beside(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """a with b to its right; width: a's columns."""
    return a.unionByName(b.withColumn("j", F.col("j") + width))


def above(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + height))


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """m x for x (j, x): (i, v)."""
    return m.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
