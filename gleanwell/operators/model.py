"""Linear models on feature rows: standardised logistic regression, out-of-fold predictions, thresholds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialise
from .skew import spread_rank


class Linear(NamedTuple):
    """A fitted model: names, means, scales and coefficients by feature, and the intercept."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float


def predict(model: Linear) -> Column:
    """The probability as a Column: sigmoid of the intercept and the weighted standard scores; a feature without spread adds nothing."""
    if len({len(model.names), len(model.mean), len(model.scale), len(model.coef)}) != 1:
        raise ValueError("names, mean, scale and coef differ in length")
    z = F.lit(model.intercept)
    for n, m, s, c in zip(model.names, model.mean, model.scale, model.coef, strict=True):
        if s:
            z = z + F.lit(c) * (F.col(n) - F.lit(m)) / F.lit(s)
    return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, names: tuple[str, ...], label: str) -> Linear:
    """Logistic regression with an L2 penalty of 1 on standard scores; label is 0 or 1. Null features must be filled before."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    mean, scale = [stats[f"m{i}"] or 0.0 for i in range(len(names))], [stats[f"s{i}"] or 0.0 for i in range(len(names))]
    scores = [((F.col(c) - mean[i]) / scale[i] if scale[i] else F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)]
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(rows.select(F.col(label).cast("double").alias("label"), *scores))
    got = LogisticRegression(regParam=1.0 / max(1, stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data.select("features", "label"))
    return Linear(tuple(names), tuple(mean), tuple(scale), tuple(float(c) for c in got.coefficients), float(got.intercept))


def out_of_fold(rows: DataFrame, names: tuple[str, ...], label: str, n: int) -> DataFrame:
    """rows with probability: each row of fold 0 to n - 1 predicted by a model of the other folds."""
    out = None
    for k in range(n):
        model = fit(rows.filter(F.col("fold") != k), names, label)
        part = rows.filter(F.col("fold") == k).withColumn("probability", predict(model))
        out = part if out is None else out.unionByName(part)
    return out


def threshold_curve(rows: DataFrame, score: str, label: str, steps: int = 100) -> DataFrame:
    """(threshold, kept, right): rows with a score of at least each step's threshold and those of them with label 1.

    Scores are counted into steps first, so the curve is a running sum over steps + 1 rows whatever the number of rows.
    """
    cell = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int")
    counts = rows.filter(F.col(score).isNotNull()).groupBy(cell.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("y"))
    steps_df = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    full = steps_df.join(counts, "step", "left")
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select((F.col("step") / steps).alias("threshold"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("kept"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("right"))


def sufficient(model: Linear, threshold: float) -> Column:
    """Whether the probability comes up to the threshold."""
    return predict(model) >= threshold


def out_of_fold_subset(rows: DataFrame, names: tuple[str, ...], label: str, n: int, subset: Column) -> DataFrame:
    """rows with probability: those of the subset out of fold among themselves, the others by one fit of the whole subset."""
    rows = materialise(rows, "rows")
    inside, outside = rows.filter(subset), rows.filter(~subset)
    return out_of_fold(inside, names, label, n).unionByName(outside.withColumn("probability", predict(fit(inside, names, label))))


def quantiles(rows: DataFrame, score: str, key: str, shares: list[float]) -> DataFrame:
    """(value): the scores at places round(share * (n - 1)), a half going to the even place, without repetition; scores are from 0 to 1."""
    known = rows.filter(F.col(score).isNotNull()).select(key, score)
    n = known.count()
    places = sorted({round(f * (n - 1)) + 1 for f in shares}) if n else []
    ranked = spread_rank(known, [], [F.col(score), F.col(key)], F.floor(F.col(score) * 4096), "r") if n else known.withColumn("r", F.lit(0))
    return ranked.filter(F.col("r").isin(places or [-1])).select(F.col(score).alias("value")).distinct()


#: Thresholds that the grid tries, in hundredths.
GRID = range(5, 100)


def threshold_grid(rows: DataFrame, costs: dict[str, float]) -> DataFrame:
    """(tau1, tau2, n, cost, under, over, right): every pair of thresholds; rows: (p1, p2, true_route).

    A row with p1 of tau1 or more goes SIMPLE, else with p2 of tau2 or more MEDIUM, else COMPLEX. Rows are counted into hundredths of both
    probabilities first; the grid is made of running sums over these counts, whatever the number of rows.
    """
    spark = rows.sparkSession
    cell = lambda c: F.least(F.floor(F.col(c) * 100 + 1e-9), F.lit(100)).cast("int")
    ranks = {r: i for i, r in enumerate(costs)}
    known = rows.filter(F.col("p1").isNotNull() & F.col("p2").isNotNull() & F.col("true_route").isin(*costs))
    counts = known.groupBy(cell("p1").alias("i"), cell("p2").alias("j")).agg(*[F.count_if(F.col("true_route") == r).alias(f"c{k}") for r, k in ranks.items()])
    axis = lambda name: spark.range(101).select(F.col("id").cast("int").alias(name))
    full = axis("i").crossJoin(axis("j")).join(counts, ["i", "j"], "left").na.fill(0)
    # below i in p1 and from j on in p2: the MEDIUM ones of tau1 = i, tau2 = j
    up = Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    from_j = full.select("i", "j", *[F.sum(f"c{k}").over(up).alias(f"u{k}") for k in range(3)])
    grid = from_j.select("i", "j", *[F.coalesce(F.sum(f"u{k}").over(along), F.lit(0)).alias(f"m{k}") for k in range(3)])
    whole = from_j.filter("j = 0").select("i", *[F.col(f"u{k}").alias(f"t{k}") for k in range(3)])
    back = Window.partitionBy(F.lit(0)).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    simple = whole.select("i", *[F.sum(f"t{k}").over(back).alias(f"s{k}") for k in range(3)], *[F.sum(f"t{k}").over(Window.partitionBy(F.lit(0))).alias(f"a{k}") for k in range(3)])
    g = grid.join(F.broadcast(simple), "i").filter(F.col("i").isin(*GRID) & F.col("j").isin(*GRID))
    col = F.col
    total = col("a0") + col("a1") + col("a2")
    n_simple, n_medium = col("s0") + col("s1") + col("s2"), col("m0") + col("m1") + col("m2")
    a, b, c = costs.values()
    left = lambda k: col(f"a{k}") - col(f"s{k}") - col(f"m{k}")
    return g.select(
        (col("i") / 100).alias("tau1"), (col("j") / 100).alias("tau2"), total.alias("n"), (a * n_simple + b * n_medium + c * (total - n_simple - n_medium)).alias("cost"),
        (col("s1") + col("s2") + col("m2")).alias("under"), (col("m0") + left(0) + left(1)).alias("over"), (col("s0") + col("m1") + left(2)).alias("right"),
    )


def best_thresholds(grid: DataFrame, most_under: int) -> DataFrame:
    """The row of the grid with the lowest cost among those of at most so many under-routed rows; ties by fewer of these, then higher thresholds. Raises if there is none."""
    fit_ = grid.filter(F.col("under") <= most_under)
    if fit_.isEmpty():
        raise ValueError(f"no pair of thresholds leaves at most {most_under} under-routed")
    return fit_.orderBy("cost", "under", F.desc(F.round(F.col("tau1") + F.col("tau2"), 6)), F.desc("tau1")).limit(1)
