"""Gradient-boosted regression and classification trees, level by level.

Rows carry the node that they stand in. A level needs two aggregates over the data: counts and gradient sums by
(node, feature, value), from which splits are scored, and the leaves' sums. Prefix sums over a continuous feature's
values run within buckets of its range, shifted by the sums of the buckets before, so no task sorts a whole feature.
A tree is a small list of nodes and becomes a literal of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, written

BUCKETS = 256
#: Up to so many categories all subsets are tried; beyond, the prefixes in order of mean gradient.
EXHAUSTIVE = 10


def gain(gl: Column, nl: Column, g: Column, n: Column, ridge: float = 0.0, cost: float = 0.0) -> Column:
    part = lambda s, k: s * s / (2 * k + F.lit(ridge))
    return part(gl, nl) + part(g - gl, n - nl) - part(g, n) - F.lit(cost)


def leaf_value(g: Column, n: Column, ridge: float = 0.0) -> Column:
    return -g / (2 * n + F.lit(ridge))


def value_sums(rows: DataFrame, keys: list[str], value: str = "x", gradient: str = "g") -> DataFrame:
    """Count and gradient sum of each value: what every split search starts from."""
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(gradient).alias("g"))


def continuous_splits(sums: DataFrame, keys: list[str], ridge: float = 0.0, cost: float = 0.0, digits: int | None = None) -> DataFrame:
    """keys, value, gain of each key's best split `x <= value`; the least value of equal gains. sums: of value_sums."""
    sums = sums.withColumn("x", F.col("x").cast("double"))
    spans = sums.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.sum("n").alias("_n"), F.sum("g").alias("_g"))
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / width * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    placed = sums.join(spans, keys).withColumn("_b", bucket.cast("int"))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"), F.sum("g").alias("_bg"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_bg").over(before), F.lit(0.0)).alias("_g0"))
    upto = Window.partitionBy(*keys, "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.join(totals, [*keys, "_b"]).select(*keys, "x", "_n", "_g", (F.col("_n0") + F.sum("n").over(upto)).alias("nl"), (F.col("_g0") + F.sum("g").over(upto)).alias("gl"))
    scanned = scanned.where(F.col("nl") < F.col("_n"))
    score = gain(F.col("gl"), F.col("nl"), F.col("_g"), F.col("_n"), ridge, cost)
    score = F.round(score, digits) if digits is not None else score
    return scanned.withColumn("gain", score).groupBy(*keys).agg(F.max_by("x", F.struct("gain", -F.col("x"))).alias("value"), F.max("gain").alias("gain"))


def categorical_splits(sums: DataFrame, keys: list[str], ridge: float = 0.0, cost: float = 0.0) -> DataFrame:
    """keys, left (the sorted categories that go left), gain of each key's best split; sums: of value_sums.

    A key's rows are its categories, so a group is small.
    """

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        cells = [(x, float(g), int(n)) for x, g, n in sorted(zip(frame.x, frame.g, frame.n))]
        g, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
        part = lambda s, k: s * s / (2 * k + ridge) if 2 * k + ridge else 0.0
        if len(cells) <= EXHAUSTIVE:
            options = [o for k in range(1, len(cells)) for o in combinations(cells, k) if o[0] == cells[0]]
        else:
            ranked = sorted(cells, key=lambda c: (c[1] / c[2], c[0]))
            options = [tuple(ranked[:k]) for k in range(1, len(ranked))]
        rows = [(part(sum(c[1] for c in o), sum(c[2] for c in o)) + part(g - sum(c[1] for c in o), n - sum(c[2] for c in o)) - part(g, n) - cost, sorted(float(c[0]) for c in o)) for o in options]
        top = max(rows, key=lambda r: r[0], default=None)
        out = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame(out | {"left": [top[1]], "gain": [top[0]]}) if top else pd.DataFrame(columns=[*keys, "left", "gain"])

    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.groupBy(*keys).applyInPandas(best, f"{kinds}, left array<double>, gain double")


@dataclass
class Tree:
    """Nodes by heap number (children of n: 2n + 1, 2n + 2): splits[n] = (feature, value or list of categories), leaves[n] = value."""

    splits: dict[int, tuple[int, float | list[float]]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def goes_left(self, node: int, features: str) -> Column:
        k, at = self.splits[node]
        x = F.get(F.col(features), F.lit(k)).cast("double")
        return x.isin(*at) if isinstance(at, list) else x <= F.lit(at)

    def value(self, features: str, node: int = 0) -> Column:
        if node in self.leaves:
            return F.lit(float(self.leaves[node]))
        if node not in self.splits:
            return F.lit(0.0)
        return F.when(self.goes_left(node, features), self.value(features, 2 * node + 1)).otherwise(self.value(features, 2 * node + 2))


def grow(rows: DataFrame, continuous: list[bool], depth: int = 5, leaf_min: int = 3, ridge: float = 0.0, cost: float = 0.0, features: str = "x") -> Tree:
    """A tree on rows (x array, g: gradient). A node splits if its best gain is above max(0, -cost)."""
    tree = Tree()
    state = written(rows.select(features, "g").withColumn("node", F.lit(0)), "rows")
    for level in range(depth + 1):
        open_ = state.where("node >= 0")
        sums = {r.node: (r.n, r.g) for r in open_.groupBy("node").agg(F.count("*").alias("n"), F.sum("g").alias("g")).collect()}
        if not sums:
            break
        found: dict[int, tuple] = {}
        if level < depth:
            cells = open_.where(F.col("node").isin(*[n for n, (size, _) in sums.items() if size > leaf_min]) if any(s > leaf_min for s, _ in sums.values()) else F.lit(False))
            cells = value_sums(cells.select("node", "g", F.posexplode(features).alias("feature", "x")), ["node", "feature"])
            ordered = [k for k, c in enumerate(continuous) if c]
            named = [k for k, c in enumerate(continuous) if not c]
            options = []
            if ordered:
                options += [(r.node, r.feature, r.value, r.gain) for r in continuous_splits(cells.where(F.col("feature").isin(*ordered)), ["node", "feature"], ridge, cost).collect()]
            if named:
                options += [(r.node, r.feature, list(r.left), r.gain) for r in categorical_splits(cells.where(F.col("feature").isin(*named)), ["node", "feature"], ridge, cost).collect()]
            for node, k, at, score in sorted(options, key=lambda o: (o[0], o[1])):
                if score > max(0.0, -cost) and (node not in found or score > found[node][2]):
                    found[node] = (k, at, score)
        for node, (n, g) in sums.items():
            if node in found:
                tree.splits[node] = found[node][:2]
            else:
                tree.leaves[node] = -g / (2 * n + ridge) if 2 * n + ridge else 0.0
        if not found:
            break
        move = F.lit(-1)
        for node in found:
            move = F.when(F.col("node") == node, F.when(tree.goes_left(node, features), 2 * node + 1).otherwise(2 * node + 2)).otherwise(move)
        before, state = state, written(state.withColumn("node", move), "rows")
        discard(before)
    discard(state)
    return tree


def forest_value(trees: list[Tree], step: float, features: str = "x") -> Column:
    return sum((F.lit(step) * t.value(features) for t in trees), F.lit(0.0))


def boost(rows: DataFrame, continuous: list[bool], rounds: int, step: float = 0.3, classes: int = 0, label: str = "label", features: str = "x", **options) -> list[list[Tree]]:
    """A forest for regression (classes 0: one list) or one for each class, one against all, on squared loss."""
    forests: list[list[Tree]] = [[] for _ in range(max(1, classes))]
    for _ in range(rounds):
        for k, trees in enumerate(forests):
            y = (F.col(label) == k).cast("double") if classes else F.col(label).cast("double")
            residual = y - forest_value(trees, step, features)
            trees.append(grow(rows.select(features, (-2 * residual).alias("g")), continuous, features=features, **options))
    return forests


def predict(rows: DataFrame, forests: list[list[Tree]], step: float = 0.3, features: str = "x") -> DataFrame:
    """rows with guess: the value, or the class of the highest value (the lowest of equal ones)."""
    values = [forest_value(f, step, features) for f in forests]
    if len(values) == 1:
        return rows.withColumn("guess", values[0])
    return rows.withColumn("_v", F.array(*values)).withColumn("guess", (F.array_position("_v", F.array_max("_v")) - 1).cast("int")).drop("_v")


def error_rate(predicted: DataFrame, label: str = "label") -> DataFrame:
    return predicted.agg(F.count("*").alias("n"), F.avg((F.col("guess") != F.col(label)).cast("double")).alias("error"))
