"""Resuming, replacing, checking: the joins that keep tables in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo whose key done lacks."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old that new has no successor for; columns are matched by name."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], time: str, tie: list[str]) -> DataFrame:
    """One row per key: the last by time, of equals the largest by tie. One pass of partial aggregates, no sort; null keys form a key."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(time).isNotNull(), time, *tie)).alias("__row"))
    return packed.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): keys with more than one value; nulls are none."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).filter(F.col("values") > 1)


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing in new, added in new, or changed; equal ones have no row. Nulls of value are equal to each other."""
    a, b = old.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), new.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full")
    state = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def require(keys: DataFrame, table: DataFrame, key: str) -> None:
    """Raise if table lacks a key."""
    lacking = keys.select(key).distinct().join(table.select(key), key, "left_anti")
    if n := lacking.count():
        raise ValueError(f"{n} keys are missing, such as {[r[0] for r in lacking.orderBy(key).limit(5).collect()]}")


def merged(runs: list[DataFrame], key: str, value: str | None = None) -> DataFrame:
    """The rows of several runs, the last run that has a key winning; with value, keys whose runs differ in it raise."""
    ranked = None
    for i, r in enumerate(runs):
        r = r.withColumn("__run", F.lit(i))
        ranked = r if ranked is None else ranked.unionByName(r)
    if value and (n := conflicts(ranked, key, value).count()):
        raise ValueError(f"{n} keys have different values of {value}")
    others = [c for c in ranked.columns if c not in (key, "__run")]
    packed = ranked.groupBy(key).agg(F.max_by(F.struct(*others), "__run").alias("__row"))
    return packed.select(key, *[F.col(f"__row.{c}").alias(c) for c in others])


def renamed(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """rows with old names in column replaced by the present ones; others stay."""
    new = F.col(column)
    for a, b in names.items():
        new = F.when(F.col(column) == a, b).otherwise(new)
    return rows.withColumn(column, new)


def renamed_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows whose columns begin with an old name, alone or before an underscore, under the present one."""
    fresh = {}
    for c in rows.columns:
        for a, b in names.items():
            if c == a or c.startswith(a + "_"):
                fresh[c] = b + c[len(a) :]
    return rows.withColumnsRenamed(fresh)
