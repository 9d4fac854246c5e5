"""The given tables as the operators take them: cleaned questions, gold, lists, traces. Each view has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_id, type_name
from ..operators import metrics, ranking
from ..operators.upkeep import latest
from ..runtime import table

PIPELINES = ("hybrid_reranker", "always_agentic", "adaptive")
ROUTES = ("SIMPLE", "MEDIUM", "COMPLEX")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One row per qa_id: the record of lowest id, its question type in plain spelling."""
    qa = table(spark, d, "qa_records").filter("qa_id IS NOT NULL")
    one = qa.groupBy("qa_id").agg(F.min_by(F.struct("query", "answer", "question_type", "evidence_list"), "record_id").alias("r"))
    return one.select("qa_id", F.col("r.query").alias("query"), F.col("r.answer").alias("answer"), type_name(F.col("r.question_type")).alias("question_type"), F.col("r.evidence_list").alias("evidence_list"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, hops) of the questions' evidence."""
    rows = questions(spark, d).select(F.col("qa_id").alias("qid"), F.explode("evidence_list").alias("e"))
    return metrics.gold_documents(rows.select("qid", doc_id(F.col("e.url")).alias("doc_id")))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """The ranked lists without repeated rows, ranks renumbered."""
    return ranking.clean(table(spark, d, "ranked_results"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """The latest trace of every pipeline and question."""
    rows = table(spark, d, "traces").filter("pipeline IS NOT NULL AND qa_id IS NOT NULL")
    return latest(rows, ["pipeline", "qa_id"], "started_at", ["total_latency_ms"]).withColumn("question_type", type_name(F.col("question_type")))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """The latest routing row of every question with both routes."""
    rows = table(spark, d, "phase9_holdout_report").filter("true_route IS NOT NULL AND predicted_route IS NOT NULL AND qa_id IS NOT NULL")
    return latest(rows, ["qa_id"], "generated_at", ["predicted_route", "true_route"])


SQL = r"""
questions AS (SELECT qa_id, r.query AS query, r.answer AS answer, nullif(regexp_replace(regexp_replace(lower(r.question_type), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g'), '') AS question_type, r.evidence_list AS evidence_list
  FROM (SELECT qa_id, arg_min({'query': query, 'answer': answer, 'question_type': question_type, 'evidence_list': evidence_list}, record_id) AS r FROM qa_records WHERE qa_id IS NOT NULL GROUP BY qa_id)),
evidence AS (SELECT qa_id AS qid, e.url AS url, substr(sha1(e.url), 1, 16) AS doc_id, e.source AS source, e.fact AS fact, pos FROM
  (SELECT qa_id, unnest(evidence_list) AS e, unnest(range(len(evidence_list))) AS pos FROM questions)),
gold AS (SELECT qid, doc_id, count(*) OVER (PARTITION BY qid) AS hops FROM (SELECT DISTINCT qid, doc_id FROM evidence WHERE doc_id IS NOT NULL)),
ranked AS (SELECT qid, method, chunk_id, doc_id, score, text, row_number() OVER (PARTITION BY qid, method ORDER BY stored, chunk_id) AS rank FROM
  (SELECT qid, method, chunk_id, min(doc_id) AS doc_id, min(rank) AS stored, max(score) AS score, max(text) AS text FROM ranked_results
   WHERE qid IS NOT NULL AND method IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL)),
collapsed AS (SELECT qid, method, doc_id, row_number() OVER (PARTITION BY qid, method ORDER BY f) AS rank FROM (SELECT qid, method, doc_id, min(rank) AS f FROM ranked GROUP BY ALL)),
tr AS (SELECT * EXCLUDE (n, question_type), nullif(regexp_replace(regexp_replace(lower(question_type), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g'), '') AS question_type FROM
  (SELECT *, row_number() OVER (PARTITION BY pipeline, qa_id ORDER BY started_at DESC NULLS LAST, total_latency_ms DESC NULLS LAST) AS n FROM traces WHERE pipeline IS NOT NULL AND qa_id IS NOT NULL) WHERE n = 1),
routes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY generated_at DESC NULLS LAST, predicted_route DESC, true_route DESC) AS n FROM phase9_holdout_report
  WHERE true_route IS NOT NULL AND predicted_route IS NOT NULL AND qa_id IS NOT NULL) WHERE n = 1)
"""
