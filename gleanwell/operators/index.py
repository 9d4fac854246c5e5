"""A stored index of documents and BM25 over it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..runtime import broadcast_if_small, materialise
from .blocks import topk

K1, B = 1.2, 0.75
#: Entries of the matrix that scoring holds at once.
CELLS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def doc_lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(doc, words): the number of words of every document."""
    return docs.select(F.col(key).alias("doc"), F.size(tokens(text)).alias("words"))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, doc, tf, words), one row per document and distinct word; words is the document's length."""
    rows = docs.select(F.col(key).alias("doc"), tokens(text).alias("w")).withColumn("words", F.size("w"))
    return rows.select("doc", "words", F.explode("w").alias("term")).groupBy("doc", "words", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf): documents and places of every word."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


class Index(NamedTuple):
    """docs: (doc, words, terms, tfs), one row per document; stats: (term, df); size: documents; mean: words of a document."""

    docs: DataFrame
    stats: DataFrame
    size: int
    mean: float


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, terms, tfs, at = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            found = Counter(_WORD.findall((text or "").lower()))
            lengths.append(found.total())
            terms.extend(found)
            tfs.extend(found.values())
            at.append(len(terms))
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["doc", "words", "terms", "tfs"])


def build(docs: DataFrame, key: str, text: Column) -> Index:
    """The index of docs, each tokenised once; null texts have no words. Written to the shared folder."""
    rows = docs.select(F.col(key).alias("doc"), text.alias("text"))
    return _described(materialise(rows.mapInArrow(_count_batches, f"doc {rows.dtypes[0][1]}, words int, terms array<string>, tfs array<int>"), "index"))


def _described(docs: DataFrame) -> Index:
    size, mean = docs.agg(F.count(F.lit(1)), F.avg("words")).first()
    stats = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(docs, stats, size, float(mean or 0.0))


def store(ix: Index, path: str) -> None:
    """Write an index to path, in place of what is there."""
    ix.docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    ix.stats.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/stats")


def reopen(spark: SparkSession, path: str) -> Index:
    """The index that store wrote."""
    ix = _described(spark.read.parquet(f"{path}/docs"))
    return ix._replace(stats=spark.read.parquet(f"{path}/stats"))


def check(ix: Index, expected: DataFrame, key: str) -> int:
    """The number of documents, if the index has exactly those of expected, each once; else it raises."""
    ids = expected.select(F.col(key).alias("doc")).filter("doc IS NOT NULL").distinct()
    lacking, extra, twice = missing(ids, ix.docs, "doc").count(), missing(ix.docs, ids, "doc").count(), ix.size - ix.docs.select("doc").distinct().count()
    if lacking or extra or twice:
        raise ValueError(f"the index lacks {lacking} documents, has {extra} that are none and {twice} twice")
    return ix.size


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct words of queries(qid, query)."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def _bm25_scores(mean: float):
    def score(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
        asked = [np.asarray(t) for t in queries["terms"]]
        vocabulary, place = np.unique(np.concatenate(asked), return_inverse=True)
        weights = np.zeros((len(vocabulary), len(queries)))
        weights[place, np.repeat(np.arange(len(queries)), [len(t) for t in asked])] = np.concatenate([np.asarray(w) for w in queries["idf"]])
        values = pa.array(vocabulary, pa.string())
        out = np.empty((len(queries), len(rows)))
        step = max(1, CELLS // max(1, len(vocabulary)))
        for lo in range(0, len(rows), step):
            part = rows.iloc[lo : lo + step]
            sizes = [len(t) for t in part["terms"]]
            flat = np.concatenate(part["terms"].to_numpy()) if sum(sizes) else np.zeros(0, dtype=object)
            term = pa.compute.index_in(pa.array(flat, pa.string()), value_set=values).fill_null(-1).to_numpy()
            doc, tf = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["tfs"].to_numpy()).astype(np.float64) if sum(sizes) else np.zeros(0)
            known = term >= 0
            matrix = np.zeros((len(part), len(vocabulary)))
            long = K1 * (1 - B + B * part["words"].to_numpy() / mean)
            matrix[doc[known], term[known]] = tf[known] * (K1 + 1) / (tf[known] + long[doc[known]])
            out[:, lo : lo + step] = (matrix @ weights).T
        return np.where(out > 0, np.round(out, 6), -np.inf)

    return score


def search(ix: Index, asked: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): the k best documents for each question of asked(qid, term), ties by doc; scores are rounded to 6 places.

    Exact: every document is scored against every question in one pass over the index, part by part. A question of whose words no
    document has any finds nothing.
    """
    terms = materialise(asked.filter("term IS NOT NULL").select("qid", "term").distinct(), "asked")
    wanted = terms.select("term").distinct()
    known = ix.stats.join(broadcast_if_small(wanted, wanted.count()), "term", "left_semi")
    idf = F.log((ix.size - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = terms.join(known.select("term", idf.alias("idf")), "term").groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    queries = materialise(weighted.select("qid", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), "questions")
    return topk(ix.docs, "doc", dict(ix.docs.dtypes)["doc"], queries, _bm25_scores(ix.mean or 1.0), k, lambda: [F.desc("score"), F.col("doc")])


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """build and search in one: the k best documents for each of queries(qid, query)."""
    return search(build(docs, key, text), query_terms(queries), k)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks, without repetition: the two directions of an index check."""
    return left.select(key).filter(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")
