"""Bounded multi-hop retrieval over all questions at once.

Each hop is one search for all questions still open; what a hop brings is merged with what earlier ones brought, and a controller says
whether that is enough and what to ask next. Search and controller are functions of DataFrames. The driver counts hops, never questions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..runtime import materialise
from .index import Index, query_terms, search

#: Why a question is done.
REASONS = ("evidence_sufficient", "max_hops", "token_budget", "duplicate_query", "controller_failure", "no_words")

#: (qid, query) to (qid, doc, rank, tokens), tokens being the length that a document takes of the budget.
Search = Callable[[DataFrame], DataFrame]
#: (qid, hop, query) of the open questions and (qid, doc, hop) of what they hold, to (qid, sufficient, next_query, covered); a null sufficient is a failure.
Control = Callable[[DataFrame, DataFrame], DataFrame]


class Hops(NamedTuple):
    """evidence: (qid, hop, rank, doc), a document once per question, at its first hop; traces: (qid, hops, docs, covered, reason), one row per question."""

    evidence: DataFrame
    traces: DataFrame


def run(searcher: Search, control: Control, queries: DataFrame, hops: int = 3, budget: int | None = None, cap: int | None = None, first: DataFrame | None = None) -> Hops:
    """Up to hops searches for each of queries(qid, query).

    A query that a question has asked before, but for case and outer spaces, ends it without a search; then come, in this order, the
    token budget (evidence of over budget tokens), the controller's failure, sufficient evidence, the last hop, and a next query without
    words, which is a failure too. cap: documents that a question keeps at most, the first by hop and rank. first: the result of the first
    search, if it is there already. A question without any hit goes to the controller as well; a null query has none (no_words).
    """
    asked = materialise(queries.select("qid", "query"), "asked")
    wordless = asked.filter(F.size(tokens(F.col("query"))) == 0).select("qid", F.lit(0).alias("hops"), F.lit(0.0).alias("covered"), F.lit("no_words").alias("reason"))
    open_ = asked.filter(F.size(tokens(F.col("query"))) > 0)
    evidence, closed, seen = None, wordless, None
    for hop in range(1, hops + 1):
        same = F.lower(F.trim("query"))
        if seen is not None:
            again = materialise(open_.join(seen, [open_["qid"] == seen["sid"], same == seen["said"]], "left_semi"), "again")
            closed = closed.unionByName(again.select("qid", F.lit(hop - 1).alias("hops"), "covered", F.lit("duplicate_query").alias("reason")))
            open_ = materialise(open_.join(again.select("qid"), "qid", "left_anti"), "open")
        own = open_.select(F.col("qid").alias("sid"), same.alias("said"))
        seen = own if seen is None else seen.unionByName(own)
        found = (first if hop == 1 and first is not None else searcher(open_.select("qid", "query"))).select("qid", "doc", "rank", "tokens", F.lit(hop).alias("hop"))
        found = found if evidence is None else found.join(evidence.select("qid", "doc"), ["qid", "doc"], "left_anti")
        if cap is not None:
            held = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("held")) if evidence is not None else found.select("qid").distinct().withColumn("held", F.lit(0))
            at = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
            found = found.withColumn("at", at).join(held, "qid", "left").filter(F.col("at") + F.coalesce("held", F.lit(0)) <= cap).drop("at", "held")
        fresh = materialise(found, "hop")
        evidence = fresh if evidence is None else evidence.unionByName(fresh)
        state = open_.select("qid", F.lit(hop).alias("hop"), "query")
        answer = control(state, evidence.join(state.select("qid"), "qid", "left_semi").select("qid", "doc", "hop"))
        used = evidence.groupBy("qid").agg(F.sum("tokens").alias("used"))
        state = state.join(answer, "qid", "left").join(used, "qid", "left")
        blank = F.coalesce(F.trim("next_query"), F.lit("")) == ""
        reason = F.when(F.col("used") > (budget if budget is not None else 1 << 62), "token_budget").when(F.col("sufficient").isNull(), "controller_failure").when(F.col("sufficient"), "evidence_sufficient")
        reason = reason.when(F.lit(hop == hops), "max_hops").when(blank, "controller_failure")
        state = materialise(state.select("qid", F.lit(hop).alias("hops"), F.coalesce("covered", F.lit(0.0)).alias("covered"), reason.alias("reason"), "next_query"), "state")
        closed = closed.unionByName(state.filter("reason IS NOT NULL").drop("next_query"))
        open_ = materialise(state.filter("reason IS NULL").select("qid", F.col("next_query").alias("query"), "covered"), "open")
    docs = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("docs"))
    traces = closed.join(docs, "qid", "left").select("qid", "hops", F.coalesce("docs", F.lit(0)).alias("docs"), "covered", "reason")
    return Hops(evidence.select("qid", "hop", "rank", "doc"), traces)


def missing_words(ix: Index, queries: DataFrame, enough: float = 0.9) -> Control:
    """A controller that asks for the question's words that its documents lack, in their order; sufficient where they hold enough of them."""
    words = materialise(query_terms(queries).groupBy("qid").agg(F.collect_list("term").alias("words")), "words")

    def control(state: DataFrame, held: DataFrame) -> DataFrame:
        mine = words.join(state.select("qid"), "qid", "left_semi")
        terms = held.join(mine, "qid").join(ix.docs.select("doc", "terms"), "doc").select("qid", F.explode(F.array_intersect("words", "terms")).alias("term"))
        known = terms.groupBy("qid").agg(F.collect_set("term").alias("known"))
        lacking = F.array_except("words", F.coalesce("known", F.array().cast("array<string>")))
        out = mine.join(known, "qid", "left").withColumn("lacking", lacking).withColumn("covered", 1 - F.size("lacking") / F.size("words"))
        return out.select("qid", (F.col("covered") >= enough).alias("sufficient"), F.array_join("lacking", " ").alias("next_query"), "covered")

    return control


def multi_hop(ix: Index, queries: DataFrame, hops: int = 3, k: int = 5, enough: float = 0.9, budget: int | None = None, cap: int | None = None) -> Hops:
    """run over one index: BM25 for search, missing_words for controller; a document takes as many tokens as it has words."""

    def searcher(asked: DataFrame) -> DataFrame:
        found = search(ix, query_terms(asked), k)
        return found.join(ix.docs.select("doc", F.col("words").alias("tokens")), "doc").select("qid", "doc", "rank", "tokens")

    return run(searcher, missing_words(ix, queries, enough), queries, hops, budget, cap)
