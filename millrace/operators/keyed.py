"""Keyed tables: DataFrames with one row a key. Every operator gives a new table; nothing is changed in place.

Batches (puts, updates, keys) are DataFrames too, so many single-key operations are one plan: an equi-join on the key,
with what several operations do to one key folded before the shuffle where the fold allows it. Keys are not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Upsert: a key's row in new replaces that in table."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def put_if_absent(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def previous(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The rows that an upsert or a removal of keys replaces; keys that the table lacks have none."""
    return table.join(keys.select(key), key, "left_semi")


def get(table: DataFrame, value, key: str = "key") -> DataFrame:
    return table.where(F.col(key) == value)


def multi_get(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The rows of the asked keys, once each."""
    return table.join(keys.select(key), key, "left_semi")


def used_keys(rows: DataFrame, keys: str, key: str = "key") -> DataFrame:
    """The distinct keys in an array column of rows: what a batch needs of a model."""
    return rows.select(F.explode(keys).alias(key)).distinct()


def pull(model: DataFrame, rows: DataFrame, keys: str, key: str = "key") -> DataFrame:
    """The model's rows that a batch's key arrays name; a semi-join, so no more of the model moves."""
    return multi_get(model, used_keys(rows, keys, key), key)


def get_or_init(table: DataFrame, keys: DataFrame, init: dict[str, Column], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(the asked rows, the table after the call): init gives the columns of a key that the table lacks."""
    asked = keys.select(key).distinct()
    mark = table.withColumn("_there", F.lit(True))
    rows = asked.join(mark, key, "left")
    rows = rows.select(key, *[F.when(F.col("_there"), F.col(c)).otherwise(init[c]).alias(c) for c in table.columns if c != key]).select(*table.columns)
    missing = asked.join(table.select(key), key, "left_anti")
    missing = missing.select(key, *[init[c].alias(c) for c in table.columns if c != key])
    return rows, table.unionByName(missing)


def update(table: DataFrame, updates: DataFrame, fold: dict[str, Column], init: dict[str, Column], apply: dict[str, Column], key: str = "key") -> DataFrame:
    """Read-modify-write of many updates: fold aggregates a key's updates, apply combines old and folded values.

    apply sees the old value as the column's name and the folded one as u_<name>; init fills keys that the table
    lacks. Keys without updates stay as they are. The fold must not depend on order; see fold_ordered for one that does.
    """
    folded = updates.groupBy(key).agg(*[c.alias(f"u_{n}") for n, c in fold.items()], F.lit(True).alias("_hit"))
    both = table.withColumn("_there", F.lit(True)).join(folded, key, "full_outer")
    names = [c for c in table.columns if c != key]
    both = both.select(key, "_hit", *[F.when(F.col("_there"), F.col(c)).otherwise(init[c]).alias(c) for c in names], *[f"u_{n}" for n in fold])
    return both.select(key, *[(F.when(F.col("_hit"), apply[c]).otherwise(F.col(c)) if c in apply else F.col(c)).alias(c) for c in names]).select(*table.columns)


def fold_ordered(updates: DataFrame, order: list[str], start: Column, step: Callable[[Column, Column], Column], value: str, key: str = "key") -> DataFrame:
    """key and the fold of its updates in the given total order, for folds that depend on order.

    A key's updates must fit one row, as an ordered list; fold the commutative part before where keys are hot.
    """
    listed = updates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_u"))
    return listed.select(key, F.aggregate("_u", start, lambda acc, u: step(acc, u["_v"])).alias(value))


def append(updates: DataFrame, order: list[str], value: str, key: str = "key") -> DataFrame:
    """key and the list of its appended values in order."""
    listed = updates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_u"))
    return listed.select(key, F.transform("_u", lambda u: u["_v"]).alias(value))


def remove(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def clear(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))


def replay(log: DataFrame, op: str, sequence: list[str], key: str = "key") -> DataFrame:
    """The table that a log of put and remove operations leaves: each key's last operation decides, if it is a put.

    max_by combines before the shuffle, so a hot key costs no more than others.
    """
    others = [c for c in log.columns if c not in (key, op, *sequence)]
    last = log.groupBy(key).agg(F.max_by(F.struct(op, *others), F.struct(*sequence)).alias("_r"))
    return last.where(F.col(f"_r.{op}") == "put").select(key, *[f"_r.{c}" for c in others])


def add_vectors(updates: DataFrame, vector: str, key: str = "key", digits: int | None = None) -> DataFrame:
    """key and the element-wise sum of its vectors; sums of single elements combine before the shuffle."""
    cells = updates.select(key, F.posexplode(vector).alias("_p", "_x")).groupBy(key, "_p").agg(F.sum(F.col("_x").cast("double")).alias("_x"))
    x = F.round("_x", digits) if digits is not None else F.col("_x")
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", x.alias("_x")))).alias("_c")).select(key, F.transform("_c", lambda c: c["_x"]).alias(vector))


def count_increments(counts: DataFrame, deltas: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """counts with each cell's deltas added, not below zero; cells at zero are left out."""
    summed = deltas.groupBy(*keys).agg(F.sum(value).alias("_d"))
    both = counts.join(summed, keys, "full_outer")
    return both.select(*keys, F.greatest(F.coalesce(value, F.lit(0)) + F.coalesce("_d", F.lit(0)), F.lit(0)).alias(value)).where(F.col(value) > 0)


#: Pushes of a key that are listed together.
CHUNK = 4096


def clipped_steps(table: DataFrame, pushes: DataFrame, order: list[str], rate: float, top: float, value: str = "val", key: str = "key") -> DataFrame:
    """Each key's value after its pushes in order, each a projected step clip(old - rate * push, 0, top).

    Steps compose to functions of one form, x -> clip(x + c, lo, hi), so a key's pushes are folded in chunks by rank
    and the chunks in order: a hot key is sorted, but never listed as a whole.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, value))
    chunks = pushes.select(key, ((rank - 1) / CHUNK).cast("bigint").alias("_c"), rank.alias("_r"), F.col(value).cast("double").alias("_g"))
    inf = float("inf")
    clip = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    form = lambda c, lo, hi: F.struct(c.alias("c"), lo.alias("lo"), hi.alias("hi"))
    first = form(F.lit(0.0), F.lit(-inf), F.lit(inf))
    zero, most = F.lit(0.0), F.lit(float(top))

    def push(f: Column, g: Column) -> Column:
        d = -F.lit(rate) * g
        return form(f["c"] + d, clip(f["lo"] + d, zero, most), clip(f["hi"] + d, zero, most))

    def then(f: Column, g: Column) -> Column:
        return form(f["c"] + g["c"], clip(f["lo"] + g["c"], g["lo"], g["hi"]), clip(f["hi"] + g["c"], g["lo"], g["hi"]))

    folded = chunks.groupBy(key, "_c").agg(F.array_sort(F.collect_list(F.struct("_r", "_g"))).alias("_l"))
    folded = folded.select(key, "_c", F.aggregate(F.transform("_l", lambda x: x["_g"]), first, push).alias("_f"))
    whole = folded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_c", "_f"))).alias("_l"))
    whole = whole.select(key, F.aggregate(F.transform("_l", lambda x: x["_f"]), first, then).alias("_f"))
    out = clip(F.col(value).cast("double") + F.col("_f.c"), F.col("_f.lo"), F.col("_f.hi"))
    return table.join(whole, key, "left").select(key, F.when(F.col("_f").isNull(), F.col(value)).otherwise(out).alias(value))


def block_statistics(table: DataFrame, block: str = "block_id") -> DataFrame:
    """Rows of each block."""
    return table.groupBy(block).agg(F.count("*").alias("items"))


def placement(blocks: DataFrame, executors: int, block: str = "block_id") -> DataFrame:
    """Initial owner of each block: round-robin."""
    return blocks.select(block, (F.col(block) % executors).alias("executor"))


def top_of(table: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """Each group's label of the highest score, the smallest label of equal ones."""
    best = F.max_by(label, F.struct(F.col(score), -F.col(label)))
    return table.groupBy(group).agg(best.alias(label), F.max(score).alias(score))


def last_rows(table: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
