"""Ranked lists (qid, method, chunk_id, doc_id, rank, score): cleaning, collapsing, fusing, reranking, cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import approx_tokens, tokens

RRF_K = 60
#: Highest rank that any list keeps for fusing.
DEPTH = 20


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark cuts each partition to k before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def clean(ranked: DataFrame) -> DataFrame:
    """One row per (qid, method, chunk_id), ranks renumbered from 1 by stored rank, then chunk. Rows without qid, method or chunk are dropped."""
    rows = ranked.filter("qid IS NOT NULL AND method IS NOT NULL AND chunk_id IS NOT NULL")
    one = rows.groupBy("qid", "method", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("rank").alias("stored"), F.max("score").alias("score"), F.max("text").alias("text"), *([F.max("rerank_score").alias("rerank_score")] if "rerank_score" in ranked.columns else []))
    w = Window.partitionBy("qid", "method").orderBy("stored", "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).drop("stored")


def collapse(ranked: DataFrame) -> DataFrame:
    """(qid, method, doc_id, rank): documents in the order in which their first chunk comes."""
    docs = ranked.groupBy("qid", "method", "doc_id").agg(F.min("rank").alias("first"))
    return docs.select("qid", "method", "doc_id", F.row_number().over(Window.partitionBy("qid", "method").orderBy("first")).alias("rank"))


def fuse(ranked: DataFrame, methods: tuple[str, str], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """(qid, chunk_id, doc_id, rrf_score, rank): reciprocal rank fusion of two lists; ties by best rank, then chunk."""
    rows = ranked.filter(F.col("method").isin(*methods) & (F.col("rank") <= depth))
    one = rows.groupBy("qid", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min("rank").alias("best"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf_score", 12)), "best", "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).drop("best")


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a question's distinct words that a text has: the default scorer for reranking. 0 for a question without words."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(pool: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, rrf_rank, rerank_score, rank): pool(qid, chunk_id, text, rank) by score, then rank, then chunk; the first k."""
    scored = pool.join(queries.select("qid", "query"), "qid").withColumn("rerank_score", F.round(overlap_score(F.col("query"), F.col("text")), 9))
    scored = scored.withColumnRenamed("rank", "rrf_rank")
    return top(scored, ["qid"], [F.desc("rerank_score"), F.col("rrf_rank"), F.col("chunk_id")], k).select("qid", "chunk_id", "rrf_rank", "rerank_score", "rank")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows whose running token sum, by rank, keeps to the budget; the first that overflows drops all behind it."""
    w = Window.partitionBy("qid", "method").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = ranked.withColumn("tokens", approx_tokens(F.col("text"))).withColumn("used", F.sum("tokens").over(w))
    return used.filter(F.col("used") <= budget)


def merge_hops(hops: DataFrame) -> DataFrame:
    """(qid, chunk_id, doc_id, hop, rank, fresh): hops(qid, hop, rank, chunk_id, doc_id); fresh on the first time a chunk comes, by hop and rank."""
    w = Window.partitionBy("qid", "chunk_id").orderBy("hop", "rank")
    return hops.select("qid", "chunk_id", "doc_id", "hop", "rank", (F.row_number().over(w) == 1).alias("fresh"))


def new_docs(hops: DataFrame) -> DataFrame:
    """(qid, hop, docs): documents that a hop brings first."""
    return hops.groupBy("qid", "doc_id").agg(F.min("hop").alias("hop")).groupBy("qid", "hop").agg(F.count(F.lit(1)).alias("docs"))
