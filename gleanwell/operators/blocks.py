"""All rows of one table against blocks of another, as matrix products of bounded size: what exact top-k search of many queries needs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top

#: Queries and rows that one piece of work takes at once.
QUERIES, ROWS = 1_000, 20_000

#: (rows, queries) to scores, one matrix row per query; 0 or less is no hit unless the caller says otherwise.
Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the k highest scores of each query with all ties at the cut; -inf is no score."""
    m = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
    return np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))


def topk(rows: DataFrame, key: str, kind: str, queries: DataFrame, score: Score, k: int, order: Callable[[], list[Column]]) -> DataFrame:
    """(qid, key, score, rank): the k best rows for every query, scores rounded to 6 places.

    rows and queries are written tables. Rows are dealt by their key into parts of about ROWS, queries into blocks of about QUERIES; each part
    meets each block once, in a task that keeps the k best of that part alone, so nothing is gathered on the driver and a task
    holds one part and one block. score gives -inf where a row is no hit.
    """
    parts, blocks = (max(1, math.ceil(df.count() / n)) for df, n in ((rows, ROWS), (queries, QUERIES)))
    parts = max(parts, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(parts * ROWS / 500)))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("__part"), each(blocks, "__block"))
    right = queries.select("*", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("__block"), each(parts, "__part"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            s = score(a.to_pandas(), b.to_pandas())
            q, r = best(s, k)
        else:
            s, (q, r) = np.zeros((0, 0)), np.zeros((2, 0), dtype=np.int64)
        return pa.table({"qid": b.column("qid").take(q), key: a.column(key).take(r), "score": pa.array(s[q, r], pa.float64())})

    found = left.groupBy("__part", "__block").cogroup(right.groupBy("__part", "__block")).applyInArrow(cell, f"qid {dict(queries.dtypes)['qid']}, `{key}` {kind}, score double")
    return top(found, ["qid"], order(), k)
