"""Held-out passages inside a corpus: pigeonhole pieces, then bit-parallel edit distance.

The unit is a window of WINDOW consecutive words of a passage. With a budget of k edits (words put in, left out or replaced) it is
split into k + 1 pieces; a text place within the budget holds one of them unchanged. The pieces of all passages are a table by their
hashes, as large as the passages need. One pass over the corpus hashes a text's runs of as many words; those that a filter of
FILTER_BITS bits over the pieces lets through go on with the words around them and are joined with the table, common pieces in
blocks. Each pair's windows are verified with Myers' bit-parallel recurrence, which here runs over many windows at once as arrays
of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_split
from ..runtime import materialise
from .lookalikes import plain
from .words import shingles, word_hashes

WINDOW = 12
#: Bits of the filter that every task holds, whatever the number of passages; a power of 2. A fuller one lets more through to the join.
FILTER_BITS = 1 << 26
_U = np.uint64


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of pattern (n, m <= 63) to any part of the same row of text (n, w)."""
    n, m = pattern.shape
    one, last, full = _U(1), _U(1 << (m - 1)), _U((1 << m) - 1)
    bits = one << np.arange(m, dtype=_U)
    up, down = np.full(n, full), np.zeros(n, dtype=_U)
    score = np.full(n, m, dtype=np.int32)
    best = score.copy()
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * bits).sum(axis=1, dtype=_U)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        grow, shrink = down | (full & ~(up | d0)), up & d0
        score += ((grow & last) != 0).astype(np.int32) - ((shrink & last) != 0).astype(np.int32)
        g = grow << one
        down = g & d0 & full
        up = ((shrink << one) | ~(g | d0)) & full
        np.minimum(best, score, out=best)
    return best


def _run_batches(size: int, before: int, after: int, least: int, shared=None):
    """(key, h, around) of every run of size words of texts of least words and more, or of those that the shared filter lets through.

    around holds the hashes of the before words in front of the run and of the after words from its first one on; 0 where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = np.asarray(batch.column(0).cast(pa.int64()))
            for lo in range(0, len(texts), 512):
                words, at = word_hashes([plain(t) for t in texts[lo : lo + 512]])
                runs, run_at = shingles(words, at, size)
                owner = np.repeat(np.arange(len(at) - 1), np.diff(run_at))
                if shared is None:
                    hit = np.flatnonzero(np.diff(at)[owner] >= least)
                else:
                    place = runs & _U(FILTER_BITS - 1)
                    hit = np.flatnonzero((shared.value[place >> _U(6)] >> (place & _U(63))) & _U(1))
                    hit = hit[np.diff(at)[owner[hit]] >= least]
                for a in range(0, len(hit), 1 << 14):
                    part = hit[a : a + (1 << 14)]
                    doc = owner[part]
                    first = part - run_at[doc] + at[doc]
                    where = first[:, None] + np.arange(-before, after)
                    inside = (where >= at[doc][:, None]) & (where < at[doc + 1][:, None])
                    around = np.where(inside, words[np.clip(where, 0, max(0, len(words) - 1))], _U(0)).view(np.int64)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(around.ravel()), before + after).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + doc]), pa.array(runs[part].view(np.int64)), lists], names=["key", "h", "around"])

    return run


def _filter(pieces: DataFrame):
    """The filter over the pieces' hashes as 64-bit words, shared with all tasks; what the driver gets is bounded by FILTER_BITS / 64 rows."""
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = pieces.select("h").distinct().groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b")).toPandas()
    words = np.zeros(FILTER_BITS // 64, dtype=_U)
    words[bits["w"].to_numpy(dtype=np.int64)] = bits["b"].to_numpy(dtype=np.int64).view(_U)
    return pieces.sparkSession.sparkContext.broadcast(words)


def _distance_batches(window: int, errors: int):
    """Least distance of each (id, item_id, text words, item words), both around one piece."""
    size = window // (errors + 1)
    before = errors * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, item = (np.asarray(batch.column(i).flatten()).view(_U).reshape(n, -1) for i in (2, 3))
            best = np.full(n, window, dtype=np.int32)
            for k in range(errors + 1):  # the window of which the piece is the k-th
                start = before - k * size
                pattern = item[:, start : start + window]
                ok = np.flatnonzero((pattern != 0).all(axis=1))
                if len(ok):
                    part = text[ok, start : start + window + 2 * errors]
                    best[ok] = np.minimum(best[ok], myers(pattern[ok], part))
            near = np.flatnonzero(best <= errors)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(best[near])], names=["id", "item_id", "distance"])

    return run


def leaks(documents: DataFrame, id_col: str, text_col: str, passages: DataFrame, errors: int = 2, window: int = WINDOW) -> DataFrame:
    """(id, item_id, distance): documents that hold window words of a passage within errors edits; no row twice.

    passages: (item_id, passage). Texts and passages are compared in the plain form of lookalikes and lower-cased, words alone.
    distance is the least over all windows. Null and empty texts or passages, passages of under window words, and texts of fewer than
    window - errors words, give no rows. Texts are taken whole; rows with one id count together. The corpus is read once,
    whatever the number of passages.
    """
    size = window // (errors + 1)
    if size < 1 or window > 63:
        raise ValueError("a window has at least one word for each piece and at most 63")
    before, kind = errors * size, "key bigint, h bigint, around array<bigint>"
    items = passages.select(F.col("item_id").cast("bigint"), "passage").filter(F.col("passage").isNotNull() & F.col("item_id").isNotNull())
    pieces = materialise(items.mapInArrow(_run_batches(size, before, window, window), kind).withColumnsRenamed({"key": "item_id", "around": "item"}), "pieces")
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # edits may widen a text place by errors words on either side
    found = rows.mapInArrow(_run_batches(size, before + errors, window + errors, window - errors, _filter(pieces)), kind)
    hits = materialise(found.withColumnsRenamed({"key": "id", "around": "words"}), "hits")
    met = join_split(hits, pieces, "h", "id", "item_id").select("id", "item_id", "words", "item")
    near = met.mapInArrow(_distance_batches(window, errors), "id bigint, item_id bigint, distance int")
    return near.groupBy("id", "item_id").agg(F.min("distance").alias("distance"))
