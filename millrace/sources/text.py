"""Text sources: lines of files, and parsers from lines to typed columns, as column expressions.

A line of white space only and a line that starts with # hold no data. Malformed data fail the query with the line in
the message (`strict=True`) or are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import let


def read_lines(spark: SparkSession, path: str | list[str], separator: str | None = None, partitions: int | None = None) -> DataFrame:
    """value: the lines of text files, compressed or not; partitions asks for at least so many input splits."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path)
    return lines.repartition(partitions) if partitions else lines


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"))


def data_lines(lines: DataFrame, column: str = "value", trim: bool = False) -> DataFrame:
    """lines without comments and empty ones. Without trim a line of blanks is data, and so is a # after a blank."""
    c = F.trim(F.col(column)) if trim else F.col(column)
    return lines.withColumn(column, c).where(~F.col(column).startswith("#") & (F.length(column) > 0))


def _check(valid: Column, line: Column, what: str, strict: bool) -> Column:
    if strict:
        return F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), line)).cast("boolean"))
    return F.coalesce(valid, F.lit(False))


def parse_key_value(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """`key value` by one space: key bigint, val string."""
    rows = data_lines(lines, column)
    parts = F.split(column, " ", 2)
    ok = _check((F.size(parts) == 2) & F.try_element_at(parts, F.lit(1)).try_cast("bigint").isNotNull(), F.col(column), "not a key and a value", strict)
    return rows.where(ok).select(parts[0].try_cast("bigint").alias("key"), F.try_element_at(parts, F.lit(2)).alias("val"))


def parse_sparse_rows(lines: DataFrame, column: str = "value", label_type: str = "float", classes: int | None = None, strict: bool = True) -> DataFrame:
    """`label index:value ...` (indices from 0): label, idx array<int>, val array<float>; keeps the other columns.

    classes: labels must be whole numbers from 0 to classes - 1.
    """
    rows = data_lines(lines, column, trim=True)

    def parsed(f: Column) -> Column:
        places = F.when(F.size(f) > 2, F.sequence(F.lit(1), F.size(f) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        idx = F.transform(places, lambda k: F.get(f, k).try_cast("int"))
        val = F.transform(places, lambda k: F.get(f, k + 1).try_cast("float"))
        return F.struct((F.size(f) % 2 == 1).alias("paired"), F.get(f, F.lit(0)).try_cast(label_type).alias("label"), idx.alias("idx"), val.alias("val"))

    def checked(p: Column) -> Column:
        ok = p["paired"] & p["label"].isNotNull() & ~F.exists(p["idx"], F.isnull) & ~F.exists(p["val"], F.isnull)
        if classes is not None:
            ok = ok & (p["label"] >= 0) & (p["label"] < classes)
        good = F.when(ok, p)
        return good.otherwise(F.raise_error(F.concat(F.lit("not a labelled row: "), F.col(column)))) if strict else good

    # One value for each line, each step bound once: a filter on the parts would parse every line again for each.
    rows = rows.withColumn("_p", let(let(F.split(column, r"[\s:]+"), parsed), checked))
    rows = rows if strict else rows.where("_p is not null")
    return rows.select(*[c for c in lines.columns if c != column], "_p.label", "_p.idx", "_p.val")


def parse_feature_types(lines: DataFrame, features: int, column: str = "value") -> DataFrame:
    """`index:type ...` of the first data line: idx, kind (continuous, categorical, or label at index features), size.

    Type 0 is continuous (for the label: regression); another is the number of categories or classes.
    """
    first = data_lines(lines, column, trim=True).limit(1)
    pair = F.explode(F.map_entries(F.str_to_map(F.col(column), F.lit(" "), F.lit(":"))))
    rows = first.select(pair.alias("e")).select(F.col("e.key").cast("int").alias("idx"), F.col("e.value").cast("int").alias("size"))
    kind = F.when(F.col("idx") == features, "label").when(F.col("size") == 0, "continuous").otherwise("categorical")
    return rows.select("idx", kind.alias("kind"), "size")


def parse_matrix_rows(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """`row: col,val col,val ...` with row and col from 1 and val from 0: one (row, col, val) for each cell."""
    rows = data_lines(lines, column, trim=True)
    head = F.split(column, ":", 2)
    cells = rows.select(F.col(column).alias("_line"), F.trim(head[0]).try_cast("int").alias("row"), F.explode(F.split(F.trim(F.try_element_at(head, F.lit(2))), r"\s+")).alias("cell"))
    parts = F.split("cell", ",")
    cells = cells.select("_line", "row", F.try_element_at(parts, F.lit(1)).try_cast("int").alias("col"), F.try_element_at(parts, F.lit(2)).try_cast("float").alias("val"))
    ok = (F.col("row") >= 1) & (F.col("col") >= 1) & (F.col("val") >= 0)
    return cells.where(_check(ok, F.col("_line"), "not a matrix row", strict)).drop("_line")


def parse_word_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """White-space separated word ids: words array<int>; keeps the other columns."""
    rows = data_lines(lines, column, trim=True)
    return rows.withColumn("words", F.transform(F.split(column, r"\s+"), lambda w: w.cast("int"))).drop(column)


def parse_adjacency(lines: DataFrame, weighted: bool, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """vertices (id) and edges (src, dst[, weight]) of `v t t ...` or, if weighted, `v t w t w ...` lines.

    Several lines of one vertex count together; a vertex without edges stays, and targets without a line are not
    vertices.
    """
    rows = data_lines(lines, column, trim=True)
    fields = F.transform(F.split(column, " +"), lambda x: x.cast("bigint"))
    rows = rows.select(F.element_at(fields, 1).alias("src"), F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))).alias("rest"))
    vertices = rows.select(F.col("src").alias("id")).distinct()
    if weighted:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("rest") / 2).cast("int") - 1), lambda k: F.struct(F.get("rest", k * 2).alias("dst"), F.get("rest", k * 2 + 1).alias("weight")))
        edges = rows.where(F.size("rest") >= 2).select("src", F.explode(pairs).alias("e")).select("src", "e.dst", "e.weight")
    else:
        edges = rows.select("src", F.explode("rest").alias("dst"))
    return vertices, edges


def parse_hosts(lines: DataFrame, value_type: str = "double", column: str = "value") -> DataFrame:
    """`host value` by white space: host, amount."""
    parts = F.split(column, r"\s+")
    return data_lines(lines, column, trim=True).select(parts[0].alias("host"), parts[1].cast(value_type).alias("amount"))


def load_keyed(rows: DataFrame, sequence: str, key: str = "key") -> DataFrame:
    """One row a key, the one with the greatest sequence: max_by, so nothing is sorted and copies combine before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), sequence).alias("_r")).select(key, "_r.*").select(*rows.columns)


def block_size(blocks: int) -> int:
    """Keys in each of the blocks that divide the non-negative 64-bit integers."""
    return (2**63 - 1) // blocks


def ordered_block(key: Column, blocks: int) -> Column:
    """The block of a non-negative key; the last block takes the remainder."""
    return F.least(F.lit(blocks - 1).cast("bigint"), F.call_function("div", key.cast("bigint"), F.lit(block_size(blocks))))


def load_unkeyed(rows: DataFrame, order: list[str], blocks: int = 1024) -> DataFrame:
    """rows with minted keys: dealt round-robin over blocks in the given order, each block's keys counted from its start.

    The order is made total by range partitioning and per-partition counts: no task sees all rows.
    """
    numbered = row_numbers(rows, order)
    rn = F.col("_rn")
    key = (rn % blocks) * F.lit(block_size(blocks)) + F.floor(rn / blocks)
    return numbered.select((rn % blocks).alias("block_id"), key.cast("bigint").alias("key"), *rows.columns)


def row_numbers(rows: DataFrame, order: list[str], name: str = "_rn") -> DataFrame:
    """rows with name: their number from 0 in the given total order, without a window over all rows.

    Rows are dealt into ranges of a fixed grid of order ranks (percentiles of the first order column), numbered within
    each range, and shifted by the sizes of the ranges before; only the ranges' sizes meet in one place.
    """
    first = order[0]
    cuts = rows.agg(F.percentile_approx(first, [k / 200 for k in range(1, 200)], 2000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.aggregate(F.array(*[(F.col(first) > F.lit(c)).cast("int") for c in cuts]), F.lit(0), lambda a, x: a + x) if cuts else F.lit(0)
    dealt = rows.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_bucket", "_local", "_before")
