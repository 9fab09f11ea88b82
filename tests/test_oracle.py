import os

import pytest
from compare import DATA, same

from millrace.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["kv_put", "kv_update_fold", "kv_operation_log", "graph_out_degrees", "la_dot", "metrics_totals"])
def test_plan_stays_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "rank"]


@pytest.mark.parametrize("name", ["la_matrix_vector_all", "la_matrix_product_all", "la_matrix_cells_all", "la_matrix_stack_all"])
def test_matrices_have_all_vectors(spark, name):
    ids = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").distinct().count()
    out = QUERIES[name](spark, DATA)
    assert out.select("i").distinct().count() == ids * (2 if name == "la_matrix_stack_all" else 1)


def test_orders_and_suppliers_are_all_read(spark):
    named = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    machines = spark.read.parquet(f"{DATA}/supplier.parquet").select("s_nationkey").distinct().count()
    assert QUERIES["kv_pull_all"](spark, DATA).count() == named and QUERIES["cost_rebalanced_all"](spark, DATA).count() == machines
