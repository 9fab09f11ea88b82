"""Multinomial logistic regression and lasso over rows with array features.

Models are small by construction (classes times features, features squared), so they are literals of the plan; every
pass over the data is one aggregate whose partial sums meet before the shuffle. Iterations are synchronous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

Matrix = Sequence[Sequence[float]]


def _array(row: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in row])


def class_scores(features: str, weights: Matrix) -> Column:
    """W x as an array, a score for each class."""
    return F.array(*[V.dot(F.col(features), _array(row)) for row in weights])


def with_probabilities(rows: DataFrame, weights: Matrix, features: str = "x") -> DataFrame:
    return rows.withColumn("_z", class_scores(features, weights)).withColumn("p", V.softmax(F.col("_z"))).drop("_z")


def softmax_gradient(rows: DataFrame, weights: Matrix, features: str = "x", label: str = "label") -> DataFrame:
    """class, feature, g: the sum over rows of (p(class) - [label is class]) * x(feature).

    Partitions add up their batches as matrix products; classes times features sums each are shuffled.
    """
    w = np.array(weights, float)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros_like(w)
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy()).astype(float)
                z = x @ w.T
                p = np.exp(z - z.max(1, keepdims=True))
                p = np.clip(p / p.sum(1, keepdims=True), 1e-7, 1 - 1e-7)
                p[np.arange(len(p)), frame["y"].to_numpy()] -= 1
                g += p.T @ x
        c, k = np.indices(g.shape)
        yield pd.DataFrame({"class": c.ravel(), "feature": k.ravel(), "g": g.ravel()})

    inputs = rows.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    return inputs.mapInPandas(partial, "class int, feature int, g double").groupBy("class", "feature").agg(F.sum("g").alias("g"))


def softmax_evaluation(rows: DataFrame, weights: Matrix, penalty: float = 0.0, features: str = "x", label: str = "label") -> DataFrame:
    """One row: n, loss (sum of -ln p(label)), penalised loss and accuracy."""
    with_p = with_probabilities(rows, weights, features)
    l2 = penalty / 2 * sum(w * w for row in weights for w in row) / len(weights)
    loss = F.sum(-F.log(F.get("p", F.col(label).cast("int"))))
    return with_p.agg(F.count("*").alias("n"), loss.alias("loss"), (loss + F.lit(l2)).alias("penalised"), F.avg((V.argmax(F.col("p")) == F.col(label)).cast("double")).alias("accuracy"))


def fit_softmax(
    rows: DataFrame, classes: int, features_n: int, epochs: int, step: float, penalty: float = 0.0, decay: float = 1.0, decay_every: int = 1,
    features: str = "x", label: str = "label", start: Matrix | None = None, block: str | None = None, history: list | None = None,
) -> list[list[float]]:
    """Weights after gradient steps on the mean loss; step shrinks by decay every decay_every epochs.

    With block an epoch takes a step on each block's rows, in order; else one on all rows. history gets a copy of the
    weights after each epoch, for evaluate_epochs.
    """
    if not 0 < decay <= 1 or decay_every < 1:
        raise ValueError("decay must be in (0, 1] and decay_every positive")
    w = [list(r) for r in start] if start else [[0.0] * features_n for _ in range(classes)]
    rows = rows.select(features, label, *([block] if block else [])).persist()
    try:
        sizes = {r[0]: r[1] for r in (rows.groupBy(block).count().collect() if block else [(None, rows.count())])}
        for epoch in range(epochs):
            rate = step * decay ** ((epoch + 1) // decay_every)
            for key, n in sorted(sizes.items(), key=lambda kv: (kv[0] is not None, kv[0])):
                batch = rows.where(F.col(block).eqNullSafe(F.lit(key))) if block else rows
                for r in softmax_gradient(batch, w, features, label).collect() if n else []:
                    w[r["class"]][r.feature] -= rate * (r.g / n + penalty * w[r["class"]][r.feature])
            if history is not None:
                history.append([list(r) for r in w])
    finally:
        rows.unpersist()
    return w


def weight_rows(spark: SparkSession, history: Sequence[Matrix]) -> DataFrame:
    """epoch, class, w: the models of a training run as a table, to be written and evaluated later."""
    return spark.createDataFrame([(e, c, [float(x) for x in row]) for e, m in enumerate(history) for c, row in enumerate(m)], "epoch int, class int, w array<double>")


def evaluate_epochs(rows: DataFrame, weights: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """epoch, n, loss, accuracy of every model of a table of weight_rows, in one pass over the data.

    The models are epochs times classes rows, so they come to the driver and travel with the tasks.
    """
    models: dict[int, list] = {}
    for r in weights.orderBy("epoch", "class").collect():
        models.setdefault(r.epoch, []).append(r.w)
    stacked = {e: np.array(m) for e, m in models.items()}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {e: np.zeros(3) for e in stacked}
        for frame in frames:
            if len(frame):
                x, y = np.stack(frame["x"].to_numpy()).astype(float), frame["y"].to_numpy()
                for e, w in stacked.items():
                    z = x @ w.T
                    p = np.exp(z - z.max(1, keepdims=True))
                    p = np.clip(p / p.sum(1, keepdims=True), 1e-7, 1 - 1e-7)
                    sums[e] += (len(y), -np.log(p[np.arange(len(y)), y]).sum(), (p.argmax(1) == y).sum())
        yield pd.DataFrame([(e, *s) for e, s in sums.items()], columns=["epoch", "n", "loss", "right"])

    inputs = rows.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    parts = inputs.mapInPandas(partial, "epoch int, n double, loss double, right double")
    return parts.groupBy("epoch").agg(F.sum("n").cast("bigint").alias("n"), F.sum("loss").alias("loss"), (F.sum("right") / F.sum("n")).alias("accuracy"))


def normal_sums(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, v): sums of products of the feature columns; column len(features) is the target."""
    names = [*features, target]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(names))]
    one = rows.agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s_{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("v")) for i, j in pairs])).alias("e")).select("e.i", "e.j", "e.v")


def lasso_pass(sums: dict[tuple[int, int], float], weights: list[float], penalty: float, step: float = 1.0) -> list[float]:
    """One cyclic pass of coordinate descent from the sums of products; columns of zeros are skipped."""
    d = len(weights)
    full = lambda i, j: sums[min(i, j), max(i, j)]
    w = list(weights)
    for k in range(d):
        square = full(k, k)
        if square < 1e-9:
            continue
        x = (full(k, d) - sum(full(k, j) * w[j] for j in range(d) if j != k)) / square
        bound = penalty / square
        new = 0.0 if abs(x) <= bound else x - bound if x > 0 else x + bound
        w[k] += step * (new - w[k])
    return w


def fit_lasso(rows: DataFrame, features: list[str], target: str, penalty: float, passes: int = 50, step: float = 1.0) -> list[float]:
    """One pass over the data for the products, then coordinate descent on them."""
    sums = {(r.i, r.j): r.v or 0.0 for r in normal_sums(rows, features, target).collect()}
    w = [0.0] * len(features)
    for _ in range(passes):
        w = lasso_pass(sums, w, penalty, step)
    return w


def squared_loss(rows: DataFrame, features: list[str], target: str, weights: list[float]) -> DataFrame:
    """One row: n and the sum of squared errors."""
    guess = sum((F.col(f).cast("double") * F.lit(float(w)) for f, w in zip(features, weights)), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.sum(F.pow(F.col(target).cast("double") - guess, 2)).alias("loss"))
