"""Non-negative matrix factorisation: cells (row, col, val) against row factors L and column factors R.

Factors are tables (id, f array<double>) that may grow with the data; cells meet them by two equi-joins on row and
column, and gradients are sums by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import discard, written


def with_errors(cells: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """cells with l, r and e = l.r - val."""
    both = cells.join(left.select(F.col("id").alias("row"), F.col("f").alias("l")), "row").join(right.select(F.col("id").alias("col"), F.col("f").alias("r")), "col")
    return both.withColumn("e", V.dot(F.col("l"), F.col("r")) - F.col("val"))


def gradient(errors: DataFrame, by: str, other: str, own: DataFrame, penalty: float) -> DataFrame:
    """id, k, g: sum of 2 e other(k) over the cells of each row (by='row') or column, plus 2 penalty own(k)."""
    cells = errors.select(F.col(by).alias("id"), "e", F.posexplode(other).alias("k", "x"))
    sums = cells.groupBy("id", "k").agg(F.sum(2 * F.col("e") * F.col("x")).alias("s"))
    mine = own.select("id", F.posexplode("f").alias("k", "w"))
    return mine.join(sums, ["id", "k"], "left").select("id", "k", (F.coalesce("s", F.lit(0.0)) + 2 * penalty * F.col("w")).alias("g"))


def loss(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("loss"))


def stepped(factors: DataFrame, grads: DataFrame, rate: float, top: float) -> DataFrame:
    """Projected step: clip(f - rate * g, 0, top)."""
    listed = grads.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("gs"))
    move = F.zip_with("f", F.transform("gs", lambda c: c["g"]), lambda w, g: F.least(F.greatest(w - F.lit(rate) * g, F.lit(0.0)), F.lit(top)))
    return factors.join(listed, "id", "left").select("id", F.when(F.col("gs").isNull(), F.col("f")).otherwise(move).alias("f"))


def initial(ids: DataFrame, rank: int, seed: int, high: float = 1.0) -> DataFrame:
    """id, f: uniform in [0, high), a function of id, position and seed alone."""
    unit = lambda k: F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * high
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), unit).alias("f"))


def fit(cells: DataFrame, rank: int, epochs: int, rate: float, penalty: float = 0.0, top: float = 1e9, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Row and column factors after full-batch projected gradient steps; each epoch's factors are written tables."""
    left = written(initial(cells.select(F.col("row").alias("id")).distinct(), rank, seed), "left")
    right = written(initial(cells.select(F.col("col").alias("id")).distinct(), rank, seed + 1), "right")
    for _ in range(epochs):
        errors = with_errors(cells, left, right)
        new_left = written(stepped(left, gradient(errors, "row", "r", left, penalty), rate, top), "left")
        new_right = written(stepped(right, gradient(errors, "col", "l", right, penalty), rate, top), "right")
        discard(left)
        discard(right)
        left, right = new_left, new_right
    return left, right


def printed(factors: DataFrame) -> DataFrame:
    """id and its factors as one line of text."""
    return factors.select("id", F.array_join(F.transform("f", lambda x: x.cast("string")), " ").alias("line"))
