import random

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.sources import text as T

# A small weighted graph and its shortest distances from 0.
LINES = ["0 1 2 2 3", "1 0 2 4 5 3 4", "2 0 3 3 1 6 3", "3 1 4 2 1 4 7 5 6 6 8", "4 1 5 3 7 7 2", "5 3 6 7 1 8 3", "6 2 3 3 8 8 4", "7 4 2 5 1 9 6", "8 5 3 6 4 9 5", "9 7 6 8 5"]
DISTANCES = {0: 0, 1: 2, 2: 3, 3: 4, 4: 7, 5: 10, 6: 6, 7: 9, 8: 10, 9: 15}


def test_shortest_paths(spark):
    v, e = T.parse_adjacency(spark.createDataFrame([(x,) for x in LINES], "value string"), weighted=True)
    assert {r.id: r.distance for r in G.shortest_paths(v, e, 0).collect()} == DISTANCES
    alone = v.unionByName(spark.createDataFrame([(77,)], "id long"))
    out = {r.id: r.distance for r in G.shortest_paths(alone, e, 0).collect()}
    assert out[77] == G.UNREACHED and all(out[r.dst] <= out[r.src] + r.weight for r in e.collect())


def test_page_rank_against_plain_python(spark):
    r = random.Random(1)
    edges = sorted({(r.randrange(40), r.randrange(60)) for _ in range(200)})  # some targets are no vertices
    n = 40
    rank = dict.fromkeys(range(n), 1.0)
    out = {k: sum(a == k for a, _ in edges) for k in range(n)}
    d = 0.8500000238418579
    for _ in range(10):
        got = dict.fromkeys(range(n), 0.0)
        for a, b in edges:
            if b in got:
                got[b] += rank[a] / out[a]
        rank = {k: (1 - d) + d * x for k, x in got.items()}
    found = G.page_rank(spark.range(n), spark.createDataFrame(edges, "src long, dst long"))
    assert all(abs(x.rank - rank[x.id]) < 1e-9 for x in found.collect()) and found.count() == n


def test_supersteps_end_without_messages(spark):
    v = spark.range(3).select("id", F.lit(0).cast("long").alias("value"), F.lit(False).alias("active"))
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    out = G.run_supersteps(v, e, F.col("value") + 1, F.max, lambda x: x, None, only_active=True)
    assert {r.value for r in out.collect()} == {0}
    assert {(r.id, r.degree) for r in G.out_degrees(v, e).collect()} == {(0, 1), (1, 0), (2, 0)}
