"""One search over live indexes: BM25 and dense lists, fused by rank and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import dense_topk
from .index import Index, query_terms, search
from .ranking import DEPTH, fuse, rerank


def lists(ix: Index, vectors: DataFrame, queries: DataFrame, pool: int = DEPTH) -> DataFrame:
    """(qid, method, chunk_id, doc_id, score, rank): the bm25 and the dense list of each of queries(qid, query, vector).

    vectors: (doc, vector); a question without a vector has no dense list, a document without one is in none.
    """
    words = search(ix, query_terms(queries), pool).select("qid", F.lit("bm25").alias("method"), "doc", "score", "rank")
    near = dense_topk(vectors, "doc", "vector", queries.select("qid", "vector"), pool).select("qid", F.lit("dense").alias("method"), F.col("vec_id").alias("doc"), "score", "rank")
    both = words.withColumn("doc", F.col("doc").cast("bigint")).unionByName(near)
    return both.select("qid", "method", F.col("doc").alias("chunk_id"), F.col("doc").alias("doc_id"), "score", "rank")


def hybrid_search(ix: Index, vectors: DataFrame, texts: DataFrame, queries: DataFrame, k: int = 5, pool: int = DEPTH) -> DataFrame:
    """(qid, doc, rrf_rank, rerank_score, rank): the lists fused, the first pool of them reranked by texts(doc, text), the first k."""
    fused = fuse(lists(ix, vectors, queries, pool), ("dense", "bm25"), depth=pool).filter(F.col("rank") <= pool)
    held = fused.join(texts.select(F.col("doc").alias("chunk_id"), "text"), "chunk_id").select("qid", "chunk_id", "text", "rank")
    return rerank(held, queries.select("qid", "query"), k).withColumnRenamed("chunk_id", "doc")
