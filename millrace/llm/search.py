"""Exact top-k inner product search with a pivot-distance index.

Inner products become distances by one more coordinate that gives all candidates the same norm M; a query's is 0, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest are the highest scores. Each vector is keyed by its nearest pivot and
its distance to it; a pivot's vectors are cut by distance into annuli, and neighbouring annuli lie in one bundle (a
large annulus in several). Queries travel in packs of one pivot. Each pack first goes to the bundle that its bounds put
nearest, which gives every query a score that its k-th best at least has; by the triangle inequality an annulus
[lo, hi] at distance d from the query holds nothing nearer than max(d - hi, lo - d), so the pack then goes only to those
other bundles of which some query can still gain, and there annuli are scored by falling bound, for the queries whose
bound reaches their k-th best so far. Scores are exact integer inner products, and no pair is scored twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import written

#: Pivots; rows that choose them, about (by the hash of their id); annuli a pivot at most.
PIVOTS, SAMPLE, ANNULI = 64, 4096, 64
#: Bundles of a small table; vectors in a bundle, about, of a larger one; queries in a pack.
BUNDLES, BUNDLE, PACK = 16, 16384, 512
#: Vectors that are scored between two looks at the bounds, about.
STEP = 2048
FLOORED = "pack long, ids binary, vs binary, least binary"
#: Relative slack of the bounds, far above rounding.
SLACK = 1e-9


def integer_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (array<double>): floor(scale * x) of each component, of the vectors that are whole and finite."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double"))
    e = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of dim numbers; a shorter vector's missing components are 0."""
    out = np.zeros((len(lists), dim))
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """A few rounds of Lloyd's algorithm from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, most).astype(int)].copy()
    for _ in range(5):
        near = _distances(sample, centres).argmin(1)
        for k in range(most):
            if (own := near == k).any():
                centres[k] = sample[own].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _lifted(m: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(0, norm2 - (m * m).sum(1)))[:, None]])


def _rows(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(n, dim) if n and dim else np.zeros((n, dim))


def _bundles(annuli: pd.DataFrame) -> pd.DataFrame:
    """annuli (pivot, annulus, n, in order) with the first and the number of each one's bundles.

    Small neighbouring annuli share a bundle, a large one has bundles of its own; about n / rows each.
    """
    rows = min(BUNDLE, max(1, int(annuli.n.sum()) // BUNDLES))
    first, count, at, held = [], [], 0, 0
    for n in annuli.n.tolist():
        own = -(-n // rows)
        if held and held + n > rows:
            at, held = at + 1, 0
        first.append(at)
        count.append(own)
        held += n
        if own > 1:
            at, held = at + own, 0
    return annuli.assign(first=first, count=count)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, pairs: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products among all other rows.

    vectors: vec_id, v (array<double> of integers; inner products below 2**53). Ties go to the smaller vec_id; a query
    with fewer than k others has all. A shorter vector's missing components are 0, and an empty vector's scores are 0.
    Rows that repeat a vec_id are one candidate each, but never their own query's; repeated query rows are one query,
    with the least of their vectors. Rows with a null vec_id or vector take no part. pairs: counts the pairs scored.
    """
    vectors = written(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"), "vectors")
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    facts = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, dim, norm2 = facts[0], facts[1], facts[2]
    if not n:
        return spark.createDataFrame([], out)
    # About SAMPLE rows by the hash of their id; more than twice as many only where ids repeat, and then cut.
    low = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = vectors.where(low).limit(2 * SAMPLE).toPandas()
    if not len(sample):
        sample = vectors.limit(1).toPandas()
    pivots = _pivots(_lifted(_matrix(sample.v, dim), norm2), min(PIVOTS, len(sample)))
    width = 2 * np.sqrt(norm2) / ANNULI or 1.0
    shared = spark.sparkContext.broadcast((pivots, norm2))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, norm2 = shared.value
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), dim)
            d = _distances(_lifted(m, norm2), pivots)
            near = d.argmin(1)
            dist = d[np.arange(len(m)), near]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(near.astype(np.int32)), pa.array((dist // width).astype(np.int32)), pa.array(dist)], ["vec_id", "v", "pivot", "annulus", "dist"]
            )

    kinds = "vec_id long, v binary, pivot int, annulus int, dist double"
    index = written(vectors.mapInArrow(assign, kinds), "index")
    # At most PIVOTS * ANNULI rows come to the driver.
    annuli = _bundles(index.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("pivot", "annulus").toPandas())
    place = spark.createDataFrame([(int(r["pivot"]), int(r["annulus"]), i, int(r["first"]), int(r["count"])) for i, r in annuli.iterrows()], "pivot int, annulus int, ring int, first long, count long")
    placed = index.join(F.broadcast(place), ["pivot", "annulus"]).select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("count"))).alias("bundle"), "ring", "vec_id", "v")

    def bundled(name: str, *more: str):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([(more[0] if more else "vec_id", "ascending")])
            ids = rows.column("vec_id").to_numpy()
            columns = {name: rows.column(name)[:1], "ids": [ids.tobytes()], "vs": [b"".join(rows.column("v").to_pylist())]}
            return pa.table(columns | {m: [rows.column(m).to_numpy().astype(np.int32).tobytes()] for m in more})

        return run

    bundles = written(placed.groupBy("bundle").applyInArrow(bundled("bundle", "ring"), "bundle long, ids binary, vs binary, ring binary"), "bundles")
    # Packs: queries of one pivot, about PACK each.
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(queries.mapInArrow(assign, kinds), "queries")
    counts = dict(queries.groupBy("pivot").count().collect())
    if not counts:
        return spark.createDataFrame([], out)
    packs = spark.createDataFrame([(int(p), max(1, -(-c // PACK))) for p, c in counts.items()], "pivot int, packs long")
    member = queries.join(F.broadcast(packs), "pivot").withColumn("pack", F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("packs")))
    packed = written(member.groupBy("pack").applyInArrow(bundled("pack"), "pack long, ids binary, vs binary"), "packs")
    layout = spark.sparkContext.broadcast(tuple(annuli[c].to_numpy(t) for c, t in (("pivot", int), ("lo", float), ("hi", float), ("n", int), ("first", int), ("count", int))))
    last = int((annuli["first"] + annuli["count"]).max())

    def bounds(q: np.ndarray) -> np.ndarray:
        """[query, annulus] the highest score that the annulus can hold."""
        pivots, norm2 = shared.value
        pivot, lo, hi = layout.value[:3]
        d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, pivot]
        away = np.maximum(0, np.maximum(d - hi, lo - d))
        most = (q * q).sum(1)[:, None] + norm2
        return (most * (1 + SLACK) - away**2 * (1 - SLACK)) / 2 + SLACK * most

    def nearest(bound: np.ndarray) -> set:
        """The bundles of the annuli with the highest mean bound, until they hold k others; of a split one the first."""
        _, _, _, sizes, first, count = layout.value
        wanted, held = set(), 0
        for a in np.argsort(-bound.mean(0), kind="stable"):
            wanted.add(int(first[a]))
            held += sizes[a] // count[a]
            if held > k:
                break
        return wanted

    def opened(first_pass: bool):
        """Each pack's row once for each bundle that it goes to; the second pass leaves out those of the first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, count = layout.value[4:]
            for b in batches:
                for row in b.to_pylist():
                    q = _rows(row["vs"], len(row["ids"]) // 8, dim)
                    bound = bounds(q)
                    chosen = near = nearest(bound)
                    if not first_pass:
                        wanted = np.flatnonzero((bound >= np.frombuffer(row["least"])[:, None]).any(0))
                        chosen = {int(first[a]) + s for a in wanted for s in range(count[a])} - near
                    for bundle in sorted(chosen):
                        yield pa.RecordBatch.from_pylist([row | {"bundle": bundle}], schema=pa.schema([("pack", pa.int64()), ("ids", pa.binary()), ("vs", pa.binary()), ("least", pa.binary()), ("bundle", pa.int64())]))

        return run

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bundle: its vectors, then its packs one by one. Annuli go by falling bound until none can matter."""
        at_bundle = ids = vs = ring = None
        for b in batches:
            for row in b.to_pylist():
                if row["pack"] is None:
                    at_bundle = row["bundle"]
                    ids, ring = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ring"], np.int32)
                    vs = _rows(row["vs"], len(ids), dim)
                    continue
                if row["bundle"] != at_bundle:
                    continue  # of a split annulus this part has no vectors
                qids = np.frombuffer(row["ids"], np.int64)
                q, floor = _rows(row["vs"], len(qids), dim), np.frombuffer(row["least"]).copy()
                here = np.unique(ring)
                bound = bounds(q)[:, here]
                order = np.argsort(-bound.max(0), kind="stable")
                sizes = np.searchsorted(ring, here, "right") - np.searchsorted(ring, here)
                best: tuple = (np.empty(0, np.int64),) * 2 + (np.empty(0),)
                step = np.cumsum(sizes[order]) // STEP
                for s in np.unique(step):
                    some = order[step == s]
                    own = np.flatnonzero((bound[:, some] >= floor[:, None]).any(1))
                    if not len(own):
                        continue
                    at = np.flatnonzero(np.isin(ring, here[some]))
                    if pairs is not None:
                        pairs.add(len(own) * len(at))
                    score = q[own] @ vs[at].T
                    score[qids[own, None] == ids[at]] = -np.inf
                    least = floor[own]
                    if len(at) > k:
                        # Ties included, which the ids decide below.
                        least = np.maximum(least, np.partition(score, len(at) - k, axis=1)[:, len(at) - k])
                    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    i, of, found = np.concatenate([best[0], own[i]]), np.concatenate([best[1], ids[at[j]]]), np.concatenate([best[2], score[i, j]])
                    keep = np.lexsort((of, -found, i))
                    i, of, found = i[keep], of[keep], found[keep]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    floor[i[rank == k - 1]] = np.maximum(floor[i[rank == k - 1]], found[rank == k - 1])
                    best = (i[rank < k], of[rank < k], found[rank < k])
                if len(best[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[2].astype(np.int64))], ["query_id", "vec_id", "score"])

    def scored(packs: DataFrame, first_pass: bool) -> DataFrame:
        """A bundle's vectors go to its task once, its packs one by one; no task holds more than one of each."""
        none = F.lit(None)
        asked = packs.mapInArrow(opened(first_pass), "pack long, ids binary, vs binary, least binary, bundle long").withColumn("ring", none.cast("binary"))
        there = bundles.select(none.cast("long").alias("pack"), "ids", "vs", none.cast("binary").alias("least"), "bundle", "ring")
        dealt = there.unionByName(asked).repartition(last, "bundle").sortWithinPartitions("bundle", F.col("pack").asc_nulls_first())
        return dealt.mapInArrow(scores, "query_id long, vec_id long, score long")

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                known = {f["query_id"]: f["least"] for f in row["floors"] or ()}
                least = np.array([known.get(i, -np.inf) for i in np.frombuffer(row["ids"], np.int64).tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([row["ids"]], pa.binary()), pa.array([row["vs"]], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["pack", "ids", "vs", "least"])

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    no_floors = packed.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,least:double>>"))
    first = written(scored(no_floors.mapInArrow(floored, FLOORED), True), "first")
    floors = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id"), F.col("score").cast("double").alias("least"))
    by_pack = member.select("pack", F.col("vec_id").alias("query_id")).join(floors, "query_id").groupBy("pack").agg(F.collect_list(F.struct("query_id", "least")).alias("floors"))
    # A pack's queries without k candidates so far have no floor.
    ready = packed.join(by_pack, "pack", "left").mapInArrow(floored, FLOORED)
    found = scored(ready, False).unionByName(first).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
