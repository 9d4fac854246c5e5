"""Exact dense top-k: blocks of query vectors against parts of all vectors, one matrix product for each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import topk


def check_dimension(vectors: DataFrame, column: str, size: int | None = None) -> int:
    """The one length of all vectors that are not null, 0 without any; other lengths, or another than size, raise."""
    sizes = vectors.filter(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if sizes[0] != sizes[1] or size is not None and sizes[0] is not None and sizes[0] != size:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} places, expected {size or 'one length'}")
    return sizes[0] or 0


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _cosines(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    a, b = (_unit(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (rows, queries))
    scores = np.round(b @ a.T, 6)
    scores[queries["qid"].to_numpy()[:, None] == rows["vec_id"].to_numpy()[None, :]] = -np.inf
    return scores


def dense_topk(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): the k vectors of highest cosine for each of queries(qid, vector), ties by vec_id; a query never finds itself.

    Null vectors take no part; all must have one length. Scores are rounded to 6 places before ranking.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).alias("vector")).filter("vector IS NOT NULL AND vec_id IS NOT NULL")
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector").filter("vector IS NOT NULL")
    return topk(rows, "vec_id", "bigint", asked, _cosines, k, lambda: [F.desc("score"), F.col("vec_id")])
