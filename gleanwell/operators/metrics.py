"""Ranking metrics, latencies and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("recall_4", "recall_5", "recall_10", "hit_4", "hit_10", "complete_4", "complete_10", "mrr_10", "ndcg_10")


def gold_documents(gold: DataFrame) -> DataFrame:
    """(qid, doc_id) distinct, with the number of gold documents of the question as hops; rows without either are dropped."""
    rows = gold.select("qid", "doc_id").filter("qid IS NOT NULL AND doc_id IS NOT NULL").distinct()
    return rows.join(rows.groupBy("qid").agg(F.count(F.lit(1)).alias("hops")), "qid")


def ranking_metrics(collapsed: DataFrame, gold: DataFrame) -> DataFrame:
    """Nine metrics per (qid, method); collapsed: (qid, method, doc_id, rank), gold: as gold_documents gives it.

    Questions without gold have no row; a gold document that is not in the list counts as missed.
    """
    asked = collapsed.select("qid", "method").distinct()
    hits = asked.join(gold, "qid").join(collapsed, ["qid", "method", "doc_id"], "left")
    within = lambda k: F.count_if(F.col("rank") <= k)
    n = F.first("hops")
    gain = lambda r: 1.0 / F.log2(r + F.lit(1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r))
    out = [(within(k) / n).alias(f"recall_{k}") for k in (4, 5, 10)]
    out += [(within(k) > 0).cast("double").alias(f"hit_{k}") for k in (4, 10)]
    out += [(within(k) == n).cast("double").alias(f"complete_{k}") for k in (4, 10)]
    out.append(F.coalesce(1.0 / F.min(F.when(F.col("rank") <= 10, F.col("rank"))), F.lit(0.0)).alias("mrr_10"))
    out.append((F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain(F.col("rank")))), F.lit(0.0)) / ideal).alias("ndcg_10"))
    return hits.groupBy("qid", "method").agg(n.alias("hops"), *out)


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value that at least this share of the values does not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def confusion(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """(truth, predicted, rows): every cell of the matrix, empty ones with 0; rows with a null or another label are left out."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    counts = rows.filter(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))
    return cells.join(counts, ["truth", "predicted"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion matrix; a ratio without a denominator is 0."""
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("rows")).otherwise(0))
    true = matrix.groupBy(F.col("truth").alias("label")).agg(right.alias("hit"), F.sum("rows").alias("support"))
    said = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("rows").alias("said"))
    p, r = (F.coalesce(F.try_divide("hit", c), F.lit(0.0)) for c in ("said", "support"))
    both = true.join(said, "label").select("label", p.alias("precision"), r.alias("recall"), "support")
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
