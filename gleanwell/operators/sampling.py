"""Stratified samples, folds and allocations; members are picked by hash order, so any partitioning gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialise
from .ranking import top
from .skew import spread_rank


def allocate(groups: DataFrame, size: int) -> DataFrame:
    """groups(stratum, n) with take: size shared out in proportion, the largest remainders first, ties by stratum, at most n each.

    groups holds one row per stratum, so ordering them is a small task.
    """
    total = Window.partitionBy(F.lit(0))
    exact = F.lit(float(size)) * F.col("n") / F.sum("n").over(total)
    base = groups.withColumn("floor", F.floor(exact)).withColumn("part", F.round(exact - F.floor(exact), 9))
    left = F.lit(size) - F.sum("floor").over(total)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("part"), "stratum"))
    return base.withColumn("take", F.least(F.col("n"), F.col("floor") + (order <= left).cast("int"))).select("stratum", "n", "take")


def hash_order(key: str, seed: int) -> Column:
    """A random order of keys that the seed settles: the sha1 of seed and key."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary"))


def stratified(rows: DataFrame, key: str, stratum: str, size: int, seed: int) -> DataFrame:
    """(key, stratum): a sample of size in which strata have their shares; rows holds each key once. Null strata are a stratum of their own."""
    named = rows.select(key, F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).withColumn("h", hash_order(key, seed))
    takes = allocate(named.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), size)
    bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("bigint")
    ranked = spread_rank(named, ["stratum"], [F.col("h"), F.col(key)], bucket, "r")
    return ranked.join(F.broadcast(takes.select("stratum", "take")), "stratum").filter(F.col("r") <= F.col("take")).select(key, "stratum")


def folds(rows: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """(key, label, fold): each label's rows dealt in hash order into folds 0 to n - 1, so that every fold has every label's share."""
    hashed = rows.select(key, label).withColumn("h", hash_order(key, seed))
    ranked = spread_rank(hashed, [label], [F.col("h"), F.col(key)], F.conv(F.substring("h", 1, 3), 16, 10).cast("bigint"), "r")
    return ranked.select(key, label, F.pmod(F.col("r") - 1, F.lit(n)).cast("int").alias("fold"))


def part(rows: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """rows(key, stratum) with picked: the fraction of all rows, every stratum in proportion, the largest remainders first, ties by stratum."""
    named = rows.select(key, stratum).withColumn("h", hash_order(key, seed))
    sizes = named.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    exact, total = F.col("n") * F.lit(fraction), Window.partitionBy(F.lit(0))
    base = sizes.withColumn("floor", F.floor(F.round(exact, 9))).withColumn("part", F.round(exact - F.col("floor"), 9))
    left = F.bround(F.sum("n").over(total) * F.lit(fraction), 0) - F.sum("floor").over(total)
    order = F.row_number().over(total.orderBy(F.desc("part"), stratum))
    takes = base.select(F.col(stratum).alias("__s"), (F.col("floor") + (order <= left).cast("int")).alias("take"))
    ranked = spread_rank(named, [stratum], [F.col("h"), F.col(key)], F.conv(F.substring("h", 1, 3), 16, 10).cast("bigint"), "r")
    return ranked.join(F.broadcast(takes), F.col(stratum).eqNullSafe(F.col("__s"))).select(key, stratum, (F.col("r") <= F.col("take")).alias("picked"))


def ensure_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if a key is in both."""
    n = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").count()
    if n:
        raise ValueError(f"{n} keys are in both")


def ensure_subset(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if a key of a is not in b."""
    n = a.select(key).distinct().join(b.select(key), key, "left_anti").count()
    if n:
        raise ValueError(f"{n} keys are not in the other")


def splits(rows: DataFrame, key: str, stratum: str, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """(split, key, stratum): development, final_holdout from what it leaves, and smoke from development, each stratified; sizes: split to (size, seed).

    A key that rows has more than once raises, and so do splits that share a key or a smoke question that is not in development.
    """
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count():
        raise ValueError("keys are not unique")
    rows = materialise(rows.select(key, stratum), "population")
    dev = materialise(stratified(rows, key, stratum, *sizes["development"]), "development")
    hold = materialise(stratified(rows.join(dev.select(key), key, "left_anti"), key, stratum, *sizes["final_holdout"]), "holdout")
    smoke = materialise(stratified(dev.withColumnRenamed("stratum", stratum), key, stratum, *sizes["smoke"]), "smoke")
    ensure_disjoint(dev, hold, key)
    ensure_subset(smoke, dev, key)
    out = None
    for name, df in (("development", dev), ("final_holdout", hold), ("smoke", smoke)):
        one = df.select(F.lit(name).alias("split"), key, "stratum")
        out = one if out is None else out.unionByName(one)
    return out


def shortage(rows: DataFrame, quotas: DataFrame, by: list[str]) -> DataFrame:
    """(by, need, have): cells of quotas(by, quota) of which rows holds too few."""
    have = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("have"))
    out = quotas.join(have, by, "left").select(*by, F.col("quota").alias("need"), F.coalesce("have", F.lit(0)).alias("have"))
    return out.filter(F.col("have") < F.col("need"))


def cells(rows: DataFrame, quotas: DataFrame, by: list[str], key: str, seed: int, strict: bool = True) -> DataFrame:
    """As many rows of each cell of quotas(by, quota) as it asks for, in hash order; strict: a cell with too few raises, else all of its rows are taken."""
    if strict and (lacking := shortage(rows, quotas, by).count()):
        raise ValueError(f"{lacking} cells have too few rows")
    asked = rows.join(F.broadcast(quotas), by).withColumn("h", hash_order(key, seed))
    most = quotas.agg(F.max("quota")).first()[0] or 0
    return top(asked, by, [F.col("h"), F.col(key)], most, "__r").filter(F.col("__r") <= F.col("quota")).drop("__r", "h", "quota")


def diverse(rows: DataFrame, key: str, facets: list[str], tier: str, most: int) -> DataFrame:
    """(key, pick): up to most rows, lower tiers first, each the one with most facet values that no earlier pick has, ties by key; pick counts from 1."""
    picked: list[tuple] = []
    seen: dict[str, set] = {f: set() for f in facets}
    # the least key of each combination is all that can be picked next but for its first few
    small = materialise(top(rows.select(key, tier, *facets), [tier, *facets], [F.col(key)], most, "__r").drop("__r"), "examples")
    while len(picked) < most:
        new = sum(((~F.coalesce(F.col(f).isin(*seen[f]), F.lit(False))).cast("int") if seen[f] else F.lit(1) for f in facets), F.lit(0))
        row = small.filter(~F.col(key).isin(*[p[0] for p in picked])) if picked else small
        row = row.orderBy(tier, F.desc(new), key).limit(1).collect()
        if not row:
            break
        picked.append((row[0][key], len(picked) + 1))
        for f in facets:
            seen[f].add(row[0][f])
    return rows.sparkSession.createDataFrame(picked, f"`{key}` {dict(rows.dtypes)[key]}, pick int")
