"""Intervals, paired comparisons and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-sided standard normal quantiles by confidence.
Z = {0.90: 1.6449, 0.95: 1.96, 0.975: 2.2414, 0.99: 2.5758}


def wilson(hits: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Both ends of the Wilson score interval of hits / n, kept within 0 and 1; null for n = 0. Other confidences than Z's raise."""
    z = Z[confidence]
    p = F.try_divide(hits, n)
    scale = 1 + z * z / F.nullif(n, F.lit(0))
    middle = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / scale
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / scale
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def bonferroni(alpha: float, comparisons: int) -> float:
    """The error each of so many comparisons may have; fewer than one raises."""
    if comparisons < 1:
        raise ValueError("there is no comparison")
    return alpha / comparisons


def excludes_zero(low: Column, high: Column) -> Column:
    """Whether 0 lies outside an interval; null for a null end."""
    return ~((low <= 0) & (high >= 0))


def normal_interval(mean: str, stdev: str, n: str, alpha: float) -> tuple[Column, Column]:
    """Both ends of the interval of a mean; null for fewer than two values. Other errors than those of Z raise."""
    half = F.lit(Z[round(1 - alpha, 6)]) * F.col(stdev) / F.sqrt(F.col(n))
    return F.col(mean) - half, F.col(mean) + half


def paired_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(n, mean, median, stdev, effect) of a - b per group; effect is mean over stdev, null for fewer than 2 pairs or no spread."""
    d = F.col("a") - F.col("b")
    out = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_samp(d).alias("stdev"))
    return out.withColumn("effect", F.try_divide("mean", F.when(F.col("stdev") > 0, F.col("stdev"))))


def bootstrap(pairs: DataFrame, by: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 2029) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean of a - b over Poisson resamples.

    Every row draws for each resample how often it is in it, by a hash of the seed, the resample and its id, so a group is
    resampled wherever its rows are; sums per resample are combined before they are shuffled. pairs: (by, id, a, b).
    """
    rows = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(by, "id", (F.col("a") - F.col("b")).alias("d"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "r", "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # inverse of the Poisson(1) distribution function at u
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    times = sum((F.when(u > e, 1).otherwise(0) for e in edges), F.lit(0))
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("k", times)
    means = drawn.groupBy(by, "r").agg(F.try_divide(F.sum(F.col("k") * F.col("d")), F.sum("k")).alias("m"))
    a = (1 - confidence) / 2
    ends = means.groupBy(by).agg(F.expr(f"percentile_disc({a}) WITHIN GROUP (ORDER BY m)").alias("low"), F.expr(f"percentile_disc({1 - a}) WITHIN GROUP (ORDER BY m)").alias("high"))
    return rows.groupBy(by).agg(F.avg("d").alias("mean")).join(ends, by)
