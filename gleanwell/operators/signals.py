"""What ranked lists say about a question before any answer: scores, gaps, agreement, change by reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_features
from .ranking import collapse


def score_gaps(ranked: DataFrame, column: str = "score") -> DataFrame:
    """(qid, method, top1, top5_mean, gap12, gap15): gap15 to the last there is of the first five; gaps are 0 for a list of one."""
    five = ranked.filter(F.col("rank") <= 5)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(column)))
    return five.groupBy("qid", "method").agg(
        at(1).alias("top1"), F.avg(column).alias("top5_mean"),
        F.coalesce(at(1) - at(2), F.lit(0.0)).alias("gap12"),
        (at(1) - F.max_by(column, "rank")).alias("gap15"),
    )


def agreement(ranked: DataFrame, collapsed: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, jaccard, common, rank_change): documents of the first ten chunks of lists a and b, shared over either (0 if both are empty);
    documents both lists have anywhere, and the mean difference of their ranks (0 without any)."""
    ten = ranked.filter(F.col("method").isin(a, b) & (F.col("rank") <= 10)).groupBy("qid", "doc_id").agg(F.count_distinct("method").alias("lists"))
    jac = ten.groupBy("qid").agg((F.count_if(F.col("lists") == 2) / F.count(F.lit(1))).alias("jaccard"))
    x = collapsed.filter(F.col("method") == a).select("qid", "doc_id", F.col("rank").alias("ra"))
    y = collapsed.filter(F.col("method") == b).select("qid", "doc_id", F.col("rank").alias("rb"))
    both = x.join(y, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("common"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("rank_change"))
    return jac.join(both, "qid", "left").select("qid", "jaccard", F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("rank_change", F.lit(0.0)).alias("rank_change"))


def rerank_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, moved, kept_docs, new_docs): before and after (qid, chunk_id, doc_id, rank). moved is the mean change of rank of the first
    five after, a chunk that was not there coming from one behind the list; kept and new documents are those of the first five."""
    size = before.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    five = after.filter(F.col("rank") <= 5).join(before.select("qid", "chunk_id", F.col("rank").alias("was")), ["qid", "chunk_id"], "left").join(size, "qid")
    moved = five.groupBy("qid").agg(F.avg(F.abs(F.col("rank") - F.coalesce("was", F.col("size") + 1))).alias("moved"))
    docs = lambda df, side: df.filter(F.col("rank") <= 5).select("qid", "doc_id", F.lit(side).alias("side")).distinct()
    per = docs(before, 1).unionByName(docs(after, 2)).groupBy("qid", "doc_id").agg(F.sum("side").alias("s"))
    counts = per.groupBy("qid").agg(F.count_if(F.col("s") == 3).alias("kept_docs"), F.count_if(F.col("s") == 2).alias("new_docs"))
    return moved.join(counts, "qid")


#: Chunks of a fused list that features look at.
FEATURE_DEPTH = 10
# The features of either stage in their order.
STAGE_1 = (
    "query_length_words", "query_length_chars", "comparison_marker_count", "has_comparison_marker", "temporal_marker_count", "has_temporal_marker", "conjunction_count",
    "has_conjunction_marker", "quoted_span_count", "numeric_date_indicator_count", "hybrid_top1_score", "hybrid_top5_mean_score", "score_gap_top1_top2", "score_gap_top1_top5",
    "dense_bm25_jaccard_top10", "consensus_fraction_top5", "mean_abs_rank_diff_common_docs", "num_unique_docs_top5", "num_unique_docs_top10",
)
STAGE_2 = ("rerank_top1_score", "rerank_top5_mean_score", "rerank_score_gap_top1_top2", "rerank_score_gap_top1_top5", "rank_change_mean_abs", "top5_overlap_with_hybrid", "num_docs_new_in_rerank_top5")


def consensus(ranked: DataFrame, fused: DataFrame) -> DataFrame:
    """(qid, consensus, docs5, docs10): of the first five documents of the fused list the share that the first ten chunks of both dense and bm25
    have; and how many documents its first five and ten are. Only the first FEATURE_DEPTH fused chunks count."""
    docs = collapse(fused.filter(F.col("rank") <= FEATURE_DEPTH))
    ten = ranked.filter(F.col("method").isin("dense", "bm25") & (F.col("rank") <= 10)).groupBy("qid", "doc_id").agg(F.count_distinct("method").alias("lists"))
    joined = docs.join(ten, ["qid", "doc_id"], "left")
    five = F.col("rank") <= 5
    return joined.groupBy("qid").agg((F.count_if(five & (F.col("lists") == 2)) / F.count_if(five)).alias("consensus"), F.count_if(five).alias("docs5"), F.count_if(F.col("rank") <= 10).alias("docs10"))


def feature_vectors(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, *STAGE_1, *STAGE_2): one row for each of queries(qid, query) with a list of method rrf; ranked: as ranking.clean gives it, with rerank_score.

    A question without a dense or a bm25 list has a jaccard and a consensus of 0, one without a reranked list nulls in the second stage.
    """
    fused, again = ranked.filter("method = 'rrf'"), ranked.filter("method = 'rerank'")
    words = queries.select("qid", *[c.cast("double").alias(n) for n, c in zip(STAGE_1[:10], query_features(F.col("query")).values(), strict=True)])
    names = ["top1", "top5_mean", "gap12", "gap15"]
    gaps = score_gaps(fused).select("qid", *[F.col(a).alias(b) for a, b in zip(names, STAGE_1[10:14])])
    agree = agreement(ranked, collapse(ranked), "dense", "bm25").select("qid", F.col("jaccard").alias(STAGE_1[14]), F.col("rank_change").alias(STAGE_1[16]))
    one = consensus(ranked, fused).select("qid", *[F.col(a).cast("double").alias(b) for a, b in zip(("consensus", "docs5", "docs10"), (STAGE_1[15], *STAGE_1[17:]))])
    after = score_gaps(again, "rerank_score").select("qid", *[F.col(a).alias(b) for a, b in zip(names, STAGE_2[:4])])
    change = rerank_change(fused, again).select("qid", F.col("moved").alias(STAGE_2[4]), F.try_divide("kept_docs", F.col("kept_docs") + F.col("new_docs")).alias(STAGE_2[5]), F.col("new_docs").cast("double").alias(STAGE_2[6]))
    out = words.join(gaps, "qid").join(one, "qid").join(agree, "qid", "left").join(after, "qid", "left").join(change, "qid", "left")
    return out.select("qid", *[F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in STAGE_1], *[F.round(n, 6).alias(n) for n in STAGE_2])
