import pytest
from pyspark.sql import functions as F

from millrace.sources import text as T


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_comments_and_counts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n# y\n\n z\n")
    read = T.read_lines(spark, str(tmp_path), partitions=2)
    assert T.line_count(read).first()[0] == 4
    assert {r.value for r in T.data_lines(read).collect()} == {"x", " z"}


def test_key_value(spark):
    assert T.parse_key_value(lines(spark, "1 a b", "# no")).first().asDict() == {"key": 1, "val": "a b"}
    with pytest.raises(Exception, match="not a key"):
        T.parse_key_value(lines(spark, "x y")).collect()
    assert T.parse_key_value(lines(spark, "x y", "2 z"), strict=False).count() == 1


def test_sparse_rows(spark):
    r = T.parse_sparse_rows(lines(spark, " 1.5 0:2 3:4.5 ", "#", "2")).orderBy("label").collect()
    assert (r[0].label, r[0].idx, r[0].val) == (1.5, [0, 3], [2.0, 4.5]) and r[1].idx == []
    with pytest.raises(Exception, match="not a labelled row"):
        T.parse_sparse_rows(lines(spark, "10 0:1"), label_type="int", classes=10).collect()


def test_matrix_words_types_hosts(spark):
    assert {tuple(r) for r in T.parse_matrix_rows(lines(spark, "1: 2,3.5 4,1", "# c")).collect()} == {(1, 2, 3.5), (1, 4, 1.0)}
    with pytest.raises(Exception, match="not a matrix row"):
        T.parse_matrix_rows(lines(spark, "0: 2,3")).collect()
    assert T.parse_word_ids(lines(spark, " 3  4 5")).first().words == [3, 4, 5]
    kinds = {tuple(r) for r in T.parse_feature_types(lines(spark, "# m", "0:0 1:3 2:10"), 2).collect()}
    assert kinds == {(0, "continuous", 0), (1, "categorical", 3), (2, "label", 10)}
    assert tuple(T.parse_hosts(lines(spark, "localhost 1.074e9")).first()) == ("localhost", 1.074e9)


def test_adjacency(spark):
    v, e = T.parse_adjacency(lines(spark, "0 1 2 2 3 ", "4", "0 9 1"), weighted=True)
    assert {r.id for r in v.collect()} == {0, 4} and {tuple(r) for r in e.collect()} == {(0, 1, 2), (0, 2, 3), (0, 9, 1)}
    v, e = T.parse_adjacency(lines(spark, "0 1 2 ", "3 "), weighted=False)
    assert v.count() == 2 and {tuple(r) for r in e.collect()} == {(0, 1), (0, 2)}


def test_row_numbers_are_total(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.x == r["_rn"] for r in T.row_numbers(rows, ["x"]).collect())
