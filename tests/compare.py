"""A query's rows against DuckDB's over the same Parquet tables."""

import math
import os

import duckdb
import numpy as np

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(cell, x))
    if x is None or x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        return float(f"{float(x):.6g}") + 0.0
    return str(x)


def rows(frame):
    return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def same(spark, query, sql, data=DATA):
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            if os.path.exists(f"{data}/{t}.parquet"):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        want = c.execute(sql).df()
    got = query(spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got), rows(want)):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-6) for x, y in zip(a, b)), (a, b)
