import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import search as S


def plain(rows, k, every):
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("n,k", [(400, 20), (12, 20), (1, 3)])
def test_top_k_against_plain(spark, monkeypatch, n, k):
    for name, value in (("BUNDLE", 32), ("PACK", 8), ("ANNULI", 8), ("PIVOTS", 5)):
        monkeypatch.setattr(S, name, value)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6) * r.choice([0.1, 1, 5])]) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[7][1]) for i in range(90)]  # one very common vector
        rows += [(2000, None), (2010, [None] + [1.0] * 5), (2020, [math.nan] * 6), (2030, [math.inf] * 6), (2040, [0.0] * 6), (2050, [1.0, 2.0]), (2051, []), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*x, 3, 4) for x in rows], "vec_id long, embedding array<float>, pivot int, block int")
    got = S.top_k(S.integer_vectors(frame), F.col("vec_id") % 10 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert set(map(tuple, got.collect())) == plain(rows, k, 10)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert S.top_k(S.integer_vectors(frame), F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert S.top_k(S.integer_vectors(one), F.lit(False)).count() == 0


def test_repeated_ids_and_empty_vectors(spark):
    """Equal ids are one candidate each; as a query the least vector counts. Without components all scores are 0."""
    rows = [(10, [2.0, 1.0]), (10, [1.0, 5.0]), (10, [1.0, 5.0]), (11, [0.5, 1.0]), (11, [3.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for _ in range(2):
        got = S.top_k(S.integer_vectors(frame), F.col("vec_id") == 10).collect()
        assert [tuple(r) for r in sorted(got, key=lambda r: r.rank)] == [(10, 1, 11, 64 * 32 + 64 * 5 * 64), (10, 2, 11, 64 * 64 * 3)]
    empty = spark.createDataFrame([(k, []) for k in range(5)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, S.top_k(S.integer_vectors(empty), F.col("vec_id") == 2, 3).collect())) == [(2, 1, 0, 0), (2, 2, 1, 0), (2, 3, 3, 0)]


def test_bundles_of_annuli():
    import pandas as pd

    sizes = [3, 1, 40, 2, 2, 95, 1]
    got = S._bundles(pd.DataFrame({"n": sizes}))
    rows = sum(sizes) // S.BUNDLES
    spans = [set(range(f, f + c)) for f, c in zip(got["first"], got["count"])]
    assert all(len(s) == -(-n // rows) for s, n in zip(spans, sizes)) and set().union(*spans) == set(range(max(max(s) for s in spans) + 1))
    assert all(len(s) == 1 or not any(s & t for t in spans if t is not s) for s in spans)


def test_share_of_pairs_opened(spark):
    """Clustered vectors: the bounds leave few pairs to score."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] * 3 + r.normal(size=16) * 0.05]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs = spark.sparkContext.accumulator(0)
    got = S.top_k(S.integer_vectors(frame), F.col("vec_id") % 20 == 0, 20, pairs)
    assert set(map(tuple, got.collect())) == plain(rows, 20, 20)
    assert 0 < pairs.value < 0.25 * 200 * 4000
