"""Queries of indexing, retrieval and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, doc_id, joined_id, query_features
from ..operators import chunking, dense, index, loop, metrics, ranking, signals
from ..runtime import spread, table
from . import views

_TEXT = r"coalesce(title, '') || chr(10) || coalesce(body, '')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "corpus_documents").select("corpus_id", "title", "body"), "corpus_id")


def _article(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).withColumn("text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_records").filter(F.col("record_id") % 50 == 0).select(F.col("record_id").alias("qid"), "query")


def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Page identities and whether the stored one agrees."""
    return table(spark, d, "corpus_documents").select("corpus_id", doc_id(F.col("url")).alias("id"), (doc_id(F.col("url")) == F.col("doc_id")).alias("agrees"))


def qa_ids(spark: SparkSession, d: str) -> DataFrame:
    """Record identities from type, query and answer."""
    return table(spark, d, "qa_records").select("record_id", joined_id(F.coalesce("question_type", F.lit("")), F.coalesce("query", F.lit("")), F.coalesce("answer", F.lit(""))).alias("id"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Approximate tokens of every document by kind."""
    rows = table(spark, d, "documents").select("doc_kind", approx_tokens(F.col("text")).alias("t"))
    return rows.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("most"))


def paragraph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every page and the words of the longest."""
    ps = chunking.paragraphs(F.col("body"), "\n")
    return table(spark, d, "corpus_documents").filter("body IS NOT NULL").select("corpus_id", F.size(ps).alias("paragraphs"), F.coalesce(F.array_max(F.transform(ps, lambda p: F.size(chunking.words(p)))), F.lit(0)).alias("longest"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every page."""
    return chunking.chunk(_pages(spark, d), "corpus_id", F.col("body"), target=120, most=160, overlap=20, separator="\n")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number and length of chunks."""
    c = chunks(spark, d)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("corpus_id").alias("docs"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 3).alias("mean"), F.median("tokens").alias("median"), F.round(F.stddev_samp("tokens"), 3).alias("stdev"), F.round(F.count(F.lit(1)) / F.count_distinct("corpus_id"), 3).alias("per_doc"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words of every page."""
    return index.doc_lengths(_article(spark, d), "corpus_id", F.col("text")).select(F.col("doc").alias("corpus_id"), "words")


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and places of every word."""
    return index.term_stats(index.postings(_article(spark, d), "corpus_id", F.col("text")))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best pages for every question whose id is divisible by 50."""
    return index.bm25(_article(spark, d), "corpus_id", F.col("text"), _asked(spark, d), 20).withColumnRenamed("doc", "corpus_id")


def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """How up to three hops of search ended for every question whose id is divisible by 50."""
    t = loop.multi_hop(index.build(_article(spark, d), "corpus_id", F.col("text")), _asked(spark, d)).traces
    return t.groupBy("reason", "hops").agg(F.count(F.lit(1)).alias("questions"), F.sum("docs").alias("docs"), F.round(F.avg("covered"), 6).alias("covered"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return dense.dense_topk(v, "vec_id", "embedding", v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 20)


def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents that ranked lists name and the corpus lacks, and the other way round."""
    a, b = table(spark, d, "ranked_results"), table(spark, d, "corpus_documents")
    sides = index.missing(a, b, "doc_id").withColumn("side", F.lit("corpus")).unionByName(index.missing(b, a, "doc_id").withColumn("side", F.lit("lists")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("lacking"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Dense and BM25 lists fused."""
    return ranking.fuse(views.ranked(spark, d), ("dense", "bm25")).withColumn("rrf_score", F.round("rrf_score", 9))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    lists = views.ranked(spark, d)
    pool = ranking.fuse(lists, ("dense", "bm25")).filter(F.col("rank") <= ranking.DEPTH)
    return pool.join(lists.groupBy("qid", "chunk_id").agg(F.max("text").alias("text")), ["qid", "chunk_id"])


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select(F.col("qa_id").alias("qid"), "query")


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists reranked by word overlap, the first 5."""
    return ranking.rerank(_pool(spark, d), _queries(spark, d), 5)


def context_matched(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists reranked and cut to as many chunks as the agentic pipeline used for the question."""
    n = views.traces(spark, d).filter("pipeline = 'always_agentic' AND num_chunks_used_for_generation IS NOT NULL").select(F.col("qa_id").alias("qid"), F.col("num_chunks_used_for_generation").alias("n"))
    return ranking.rerank(_pool(spark, d), _queries(spark, d), ranking.DEPTH).join(n, "qid").filter(F.col("rank") <= F.col("n")).select("qid", "chunk_id", "rank")


def collapse_docs(spark: SparkSession, d: str) -> DataFrame:
    """Lists of chunks as lists of documents."""
    return ranking.collapse(views.ranked(spark, d))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every list that fit 150 tokens of context."""
    return ranking.within_budget(views.ranked(spark, d), 150).select("qid", "method", "chunk_id", "rank", "used")


def _hops(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("method") == "dense", 1).when(F.col("method") == "bm25", 2).when(F.col("method") == "rrf", 3).otherwise(4)
    return views.ranked(spark, d).withColumn("hop", order)


def merge_hops(spark: SparkSession, d: str) -> DataFrame:
    """The lists of a question taken one after another: which chunks are new."""
    return ranking.merge_hops(_hops(spark, d)).select("qid", "chunk_id", "hop", "rank", "fresh")


def new_docs_per_hop(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each list brings first."""
    return ranking.new_docs(_hops(spark, d))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nine metrics of every list."""
    m = metrics.ranking_metrics(ranking.collapse(views.ranked(spark, d)), views.gold(spark, d))
    return m.select("qid", "method", "hops", *[F.round(c, 6).alias(c) for c in metrics.METRICS])


def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics by method, by method and type, by method and hops."""
    m = metrics.ranking_metrics(ranking.collapse(views.ranked(spark, d)), views.gold(spark, d))
    m = m.join(views.questions(spark, d).select(F.col("qa_id").alias("qid"), "question_type"), "qid")
    g = m.groupingSets([["method"], ["method", "question_type"], ["method", "hops"]], "method", "question_type", "hops")
    return g.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in metrics.METRICS])


def retrieval_signals(spark: SparkSession, d: str) -> DataFrame:
    """Scores and gaps of every list."""
    g = signals.score_gaps(views.ranked(spark, d))
    return g.select("qid", "method", *[F.round(c, 6).alias(c) for c in ("top1", "top5_mean", "gap12", "gap15")])


def list_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far dense and BM25 lists agree."""
    r = views.ranked(spark, d)
    return signals.agreement(r, ranking.collapse(r), "dense", "bm25").select("qid", F.round("jaccard", 6).alias("jaccard"), "common", F.round("rank_change", 6).alias("rank_change"))


def rerank_signals(spark: SparkSession, d: str) -> DataFrame:
    """How reranking changed the fused lists."""
    r = views.ranked(spark, d)
    change = signals.rerank_change(r.filter("method = 'rrf'"), r.filter("method = 'rerank'"))
    return change.select("qid", F.round("moved", 6).alias("moved"), "kept_docs", "new_docs")


def question_features(spark: SparkSession, d: str) -> DataFrame:
    """Ten features of every question."""
    return views.questions(spark, d).filter("query IS NOT NULL").select("qa_id", *[c.alias(n) for n, c in query_features(F.col("query")).items()])


QUERIES = {f.__name__: f for f in (doc_ids, qa_ids, token_counts, paragraph_stats, chunks, chunk_stats, doc_stats, term_stats, bm25_topk, multi_hop, dense_topk, index_gaps, rrf_fuse, rerank_topk, context_matched, collapse_docs, context_budget, merge_hops, new_docs_per_hop, retrieval_metrics, metrics_by_group, retrieval_signals, list_agreement, rerank_signals, question_features)}

_V = "WITH " + views.SQL
_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_POST = f"""docs AS (SELECT corpus_id, {_WORDS.format(_TEXT)} AS w FROM corpus_documents), post AS (SELECT corpus_id, len(w) AS dl, unnest(w) AS term FROM docs),
tf AS (SELECT corpus_id, dl, term, count(*) AS tf FROM post GROUP BY ALL)"""
_FUSED = f"""{_V}, fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, best, chunk_id) AS rank FROM
(SELECT qid, chunk_id, min(doc_id) AS doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best FROM ranked WHERE method IN ('dense', 'bm25') AND rank <= 20 GROUP BY ALL))"""
_METRICS = f"""{_V}, hits AS (SELECT a.qid, a.method, g.hops, c.rank FROM (SELECT DISTINCT qid, method FROM collapsed) a JOIN gold g USING (qid) LEFT JOIN collapsed c ON c.qid = a.qid AND c.method = a.method AND c.doc_id = g.doc_id),
m AS (SELECT qid, method, any_value(hops) AS hops, {", ".join(f"count(*) FILTER (rank <= {k}) / any_value(hops) AS recall_{k}" for k in (4, 5, 10))},
{", ".join(f"(count(*) FILTER (rank <= {k}) > 0)::DOUBLE AS hit_{k}, (count(*) FILTER (rank <= {k}) = any_value(hops))::DOUBLE AS complete_{k}" for k in (4, 10))},
coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10), 0) AS mrr_10,
coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(any_value(hops), 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg_10 FROM hits GROUP BY qid, method)"""
_HOPS = f"{_V}, hops AS (SELECT *, CASE method WHEN 'dense' THEN 1 WHEN 'bm25' THEN 2 WHEN 'rrf' THEN 3 ELSE 4 END AS hop FROM ranked)"


def _among(words: tuple[str, ...]) -> str:
    return "len(list_filter(regexp_extract_all(lower(query), '[a-zA-Z'']+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


def _times(pattern: str, of: str = "query") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def _features_sql() -> str:
    from ..functions import text as t

    comparison = _among(t.COMPARISON)
    temporal = f"({_among(t.TEMPORAL)} + {_times('over time', 'lower(query)')})"
    conjunction = f"({_among(t.CONJUNCTIONS)} + {_times('as well as', 'lower(query)')} + {_times('along with', 'lower(query)')})"
    numeric = _times(rf"(?i)\b({'|'.join(t.MONTHS)})\b") + " + " + _times(r"\b(19|20)\d{2}\b") + " + " + _times(r"\b\d+(st|nd|rd|th)?\b")
    quoted = _times("''[^'']{2,80}''|\"[^\"]{2,80}\"")
    return f"""{_V} SELECT qa_id, len(regexp_extract_all(lower(query), '[a-zA-Z'']+')) AS words, length(query) AS chars, {comparison} AS comparison, ({comparison} > 0)::INT AS has_comparison, {temporal} AS temporal,
({temporal} > 0)::INT AS has_temporal, {conjunction} AS conjunction, ({conjunction} > 0)::INT AS has_conjunction, {quoted} AS quoted, {numeric} AS numeric FROM questions WHERE query IS NOT NULL"""


ORACLES = {
    "doc_ids": "SELECT corpus_id, substr(sha1(url), 1, 16) AS id, substr(sha1(url), 1, 16) = doc_id AS agrees FROM corpus_documents",
    "qa_ids": "SELECT record_id, substr(sha1(coalesce(question_type, '') || chr(31) || coalesce(query, '') || chr(31) || coalesce(answer, '')), 1, 16) AS id FROM qa_records",
    "token_counts": "SELECT doc_kind, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens, max(t) AS most FROM (SELECT doc_kind, greatest(1, length(coalesce(text, '')) // 4) AS t FROM documents) GROUP BY 1",
    "paragraph_stats": r"""SELECT corpus_id, len(p) AS paragraphs, coalesce(list_max(list_transform(p, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')))), 0) AS longest FROM
(SELECT corpus_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM corpus_documents WHERE body IS NOT NULL)""",
    "doc_stats": f"SELECT corpus_id, len({_WORDS.format(_TEXT)}) AS words FROM corpus_documents",
    "term_stats": f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term",
    "bm25_topk": f"""WITH {_POST}, n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT record_id AS qid, unnest(list_distinct({_WORDS.format("coalesce(query, '')")})) AS term FROM qa_records WHERE record_id % 50 = 0),
scored AS (SELECT qid, corpus_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN df USING (term) JOIN tf USING (term) CROSS JOIN n GROUP BY ALL)
SELECT * FROM (SELECT qid, corpus_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, corpus_id) AS rank FROM scored) WHERE rank <= 20""",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "index_gaps": """SELECT side, count(*) AS lacking FROM (SELECT DISTINCT doc_id, 'corpus' AS side FROM ranked_results WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM corpus_documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT DISTINCT doc_id, 'lists' FROM corpus_documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM ranked_results WHERE doc_id IS NOT NULL)) GROUP BY side""",
    "rrf_fuse": f"{_FUSED} SELECT qid, chunk_id, doc_id, round(s, 9) AS rrf_score, rank FROM fused",
    "rerank_topk": f"""{_FUSED}, texts AS (SELECT qid, chunk_id, max(text) AS text FROM ranked GROUP BY ALL),
scored AS (SELECT f.qid, f.chunk_id, f.rank AS rrf_rank, list_distinct({_WORDS.format("coalesce(q.query, '')")}) AS q, {_WORDS.format("coalesce(t.text, '')")} AS t FROM fused f JOIN texts t USING (qid, chunk_id) JOIN questions q ON q.qa_id = f.qid WHERE f.rank <= 20),
s AS (SELECT qid, chunk_id, rrf_rank, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 9) AS rerank_score FROM scored)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rrf_rank, chunk_id) AS rank FROM s) WHERE rank <= 5""",
    "collapse_docs": f"{_V} SELECT * FROM collapsed",
    "context_budget": f"""{_V} SELECT * FROM (SELECT qid, method, chunk_id, rank, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY qid, method ORDER BY rank) AS BIGINT) AS used FROM ranked) WHERE used <= 150""",
    "merge_hops": f"{_HOPS} SELECT qid, chunk_id, hop, rank, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY hop, rank) = 1 AS fresh FROM hops",
    "new_docs_per_hop": f"{_HOPS} SELECT qid, hop, count(*) AS docs FROM (SELECT qid, doc_id, min(hop) AS hop FROM hops GROUP BY ALL) GROUP BY ALL",
    "retrieval_metrics": f"{_METRICS} SELECT qid, method, hops, {', '.join(f'round({c}, 6) AS {c}' for c in metrics.METRICS)} FROM m",
    "metrics_by_group": f"""{_METRICS} SELECT method, question_type, hops, CAST(grouping(method, question_type, hops) AS INT) AS level, count(*) AS questions, {', '.join(f'round(avg({c}), 6) AS {c}' for c in metrics.METRICS)}
FROM (SELECT m.*, q.question_type FROM m JOIN questions q ON q.qa_id = m.qid) GROUP BY GROUPING SETS ((method), (method, question_type), (method, hops))""",
    "retrieval_signals": f"""{_V} SELECT qid, method, round(max(score) FILTER (rank = 1), 6) AS top1, round(avg(score), 6) AS top5_mean, round(coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 0), 6) AS gap12,
round(max(score) FILTER (rank = 1) - arg_max(score, rank), 6) AS gap15 FROM ranked WHERE rank <= 5 GROUP BY ALL""",
    "list_agreement": f"""{_V}, ten AS (SELECT qid, doc_id, count(DISTINCT method) AS n FROM ranked WHERE method IN ('dense', 'bm25') AND rank <= 10 GROUP BY ALL), j AS (SELECT qid, count(*) FILTER (n = 2) / count(*) AS jaccard FROM ten GROUP BY qid),
b AS (SELECT x.qid, count(*) AS common, avg(abs(x.rank - y.rank)) AS ch FROM collapsed x JOIN collapsed y ON x.qid = y.qid AND x.doc_id = y.doc_id AND x.method = 'dense' AND y.method = 'bm25' GROUP BY x.qid)
SELECT qid, round(jaccard, 6) AS jaccard, coalesce(common, 0) AS common, round(coalesce(ch, 0), 6) AS rank_change FROM j LEFT JOIN b USING (qid)""",
    "rerank_signals": f"""{_V}, a AS (SELECT * FROM ranked WHERE method = 'rerank' AND rank <= 5), b AS (SELECT * FROM ranked WHERE method = 'rrf'), sz AS (SELECT qid, count(*) AS n FROM b GROUP BY qid),
mv AS (SELECT a.qid, avg(abs(a.rank - coalesce(b.rank, sz.n + 1))) AS moved FROM a JOIN sz USING (qid) LEFT JOIN b ON b.qid = a.qid AND b.chunk_id = a.chunk_id GROUP BY a.qid),
dd AS (SELECT qid, doc_id, sum(s) AS s FROM (SELECT DISTINCT qid, doc_id, 1 AS s FROM b WHERE rank <= 5 UNION ALL SELECT DISTINCT qid, doc_id, 2 FROM a) GROUP BY ALL)
SELECT qid, round(moved, 6) AS moved, count(*) FILTER (s = 3) AS kept_docs, count(*) FILTER (s = 2) AS new_docs FROM mv JOIN dd USING (qid) GROUP BY qid, moved""",
    "question_features": _features_sql(),
}

# the same lists as rerank_topk's, cut to each question's own number
ORACLES["context_matched"] = ORACLES["rerank_topk"].replace("SELECT * FROM (SELECT *, row_number()", "SELECT qid, chunk_id, rank FROM (SELECT *, row_number()").replace("WHERE rank <= 5", "JOIN tr ON tr.qa_id = qid AND tr.pipeline = 'always_agentic' WHERE rank <= tr.num_chunks_used_for_generation")
