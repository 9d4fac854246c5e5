"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import BROADCAST_ROWS, materialise

#: At most this many keys can each hold more than 1/HEAVY_KEYS of the counted rows; they may be broadcast.
HEAVY_KEYS = 10_000


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str], count: str, rows: int, total: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of left with a table that has one row per key and the key's number of rows.

    counted: unique on keys; rows: its rows; total: the sum of its counts. Up to bound rows it is broadcast. Beyond, the keys
    that hold over total / HEAVY_KEYS rows, HEAVY_KEYS at most, are broadcast and the rest, none of which is hot, is shuffled.
    Null keys match nothing.
    """
    if rows <= bound:
        return left.join(F.broadcast(counted), keys)
    cut = max(1, total // HEAVY_KEYS)
    heavy = counted.filter(F.col(count) > cut)
    light = counted.filter(F.col(count) <= cut)
    hot = left.join(F.broadcast(heavy), keys)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return hot.unionByName(rest)


def spread_rank(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """row_number() over (partition by group order by order) without a task that holds a whole group.

    bucket: a long that never falls as order rises, so that rows of a lower bucket come first. Rows are numbered within
    (group, bucket) and the sizes of the lower buckets, counted beforehand, are added. Nulls in group form a group.
    """
    b, n, before = f"__{name}_b", f"__{name}_n", f"__{name}_before"
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], F.col(b).alias("__kb"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    on = F.col(b).eqNullSafe(F.col("__kb"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    own = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order))
    joined = df.withColumn(name, own).join(offsets, on)
    return joined.withColumn(name, F.col(name) + F.col(before)).drop(b, before, "__kb", *[f"__k{i}" for i in range(len(group))])


#: Rows of one key that one piece of work takes from either side.
BLOCK = 1_000


def _block(id_col: str, n: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.ceil(n / F.lit(size))).cast("int")


def _each_block(n: Column, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(n / F.lit(size)).cast("int") - 1))


def self_pairs(rows: DataFrame, keys: list[str], id_col: str, n: str, condition: Column | None = None, size: int | None = None) -> DataFrame:
    """x and y, x.id < y.id, of rows with equal keys, as columns of the aliases x and y; condition may name both.

    n: the column with the number of rows of the key. The rows of a key are dealt into blocks of about size rows and every two blocks
    meet by themselves, so a key of any number of rows is many small pieces of work. Null keys match nothing.
    """
    size = size or BLOCK
    own = rows.withColumn("__own", _block(id_col, F.col(n), size)).withColumn("__other", _each_block(F.col(n), size))
    met = own.withColumns({"__low": F.least("__own", "__other"), "__high": F.greatest("__own", "__other")}).drop("__other")
    on = (F.col(f"x.{id_col}") < F.col(f"y.{id_col}")) & ((F.col("x.__low") == F.col("x.__high")) | (F.col("x.__own") != F.col("y.__own")))
    for k in [*keys, "__low", "__high"]:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return met.alias("x").join(met.alias("y"), on if condition is None else on & condition)


def join_split(left: DataFrame, right: DataFrame, key: str | list[str], left_id: str, right_id: str, size: int | None = None) -> DataFrame:
    """Inner join on key, one column or several, in which no piece of work has more than about size rows of a key from either side.

    Both sides are counted by key first; the rows of a key are dealt into blocks by the hash of their ids, and each block of one side
    meets each of the other. left and right are read twice, so they should be tables. Null keys match nothing.
    """
    size = size or BLOCK
    keys = [key] if isinstance(key, str) else key
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for side, name in ((left, "__nl"), (right, "__nr"))]
    sizes = materialise(counts[0].join(counts[1], keys).withColumn("__n", F.col("__nl") + F.col("__nr")), "sizes")
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    a, b = (join_counted(side, sizes, keys, "__n", rows, total).drop("__n") for side in (left, right))
    a = a.withColumn("__a", _block(left_id, F.col("__nl"), size)).withColumn("__b", _each_block(F.col("__nr"), size)).drop("__nl", "__nr")
    b = b.withColumn("__b", _block(right_id, F.col("__nr"), size)).withColumn("__a", _each_block(F.col("__nl"), size)).drop("__nl", "__nr")
    return a.join(b, [*keys, "__a", "__b"]).drop("__a", "__b")
