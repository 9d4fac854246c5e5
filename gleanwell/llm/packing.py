"""Texts of varying length into containers of fixed capacity: vector bin packing.

A container is limited in tokens, in segments and in loss-bearing tokens, those an instruction model learns from: of a text with an
answer the tokens from the answer on, else all. Texts longer than a container are cut into full pieces and a rest. Pieces are spread
over shards by a hash, each of about SHARD_ITEMS; a shard fills one container at a time and takes, of all pieces that still fit, the
one whose demand has the largest dot product with what is left, all relative to the limits. Alike pieces are one kind with a number,
so a step costs an array operation over the kinds.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: what the answer of a text with question and answer begins with.
ANSWER = "\nAnswer:"
SHARD_ITEMS = 20_000
#: Capacities that one call takes.
MOST_CAPACITIES = 1_000
#: A container holds at most a segment for so many tokens of capacity, and this share of the capacity in loss-bearing tokens.
TOKENS_PER_SEGMENT, LOSS_SHARE = 32, 0.995
#: What closes a container: no waiting piece fits its tokens, its segments are used up, waiting pieces would fit but for their loss-bearing tokens, none waits.
STOPS = ("tokens", "segments", "loss", "last")


def _count_batches(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            total, loss = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n = len(encoding.encode_ordinary(text))
                at = text.find(ANSWER)
                total.append(n)
                loss.append(n if at < 0 else max(0, n - len(encoding.encode_ordinary(text[:at]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(loss, pa.int64())], names=["id", "tokens", "loss"])

    return run


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens, loss) of every row; null and empty texts have 0 tokens. vocabulary: a file of base64 tokens and ranks on the driver."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the number of documents
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count_batches(shared, pattern), "id bigint, tokens bigint, loss bigint")


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The container, from 0, of each piece, and the place in STOPS of what closed each container.

    A piece beyond a limit other than tokens has a container of its own, which that limit has closed.
    """
    kinds, kind_of, left = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True, return_counts=True)
    t, q = kinds[:, 0], kinds[:, 1]
    # pieces of each kind in turn
    waiting = np.argsort(kind_of.ravel(), kind="stable")
    nxt = np.concatenate(([0], np.cumsum(left)[:-1]))
    demand = np.stack([t / capacity, np.full(len(t), 1 / segments), q / max(1, loss_limit)])
    out = np.full(len(tokens), -1, dtype=np.int64)
    stops: list[int] = []
    remaining = len(tokens)

    def put(k: int) -> None:
        nonlocal remaining
        out[waiting[nxt[k]]] = len(stops)
        nxt[k] += 1
        left[k] -= 1
        remaining -= 1

    while remaining:
        room = np.array([capacity, segments, loss_limit], dtype=np.int64)
        while remaining and room[1]:
            fits = (left > 0) & (t <= room[0]) & (q <= room[2])
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, (room / (capacity, segments, max(1, loss_limit))) @ demand, -1.0)))
            put(k)
            room -= (t[k], 1, q[k])
        if room[1] == segments:  # nothing fits an empty container: the largest goes alone
            put(int(np.argmax(np.where(left > 0, t, -1))))
            stops.append(2)
        elif not remaining:
            stops.append(3)
        else:
            stops.append(1 if not room[1] else 2 if ((left > 0) & (t <= room[0])).any() else 0)
    return out, np.array(stops, dtype=np.int64)


def _fill_group(segments_per: int, loss_share: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"])
        capacity, shard = int(group["capacity"].iloc[0]), int(group["shard"].iloc[0])
        box, stops = fill(group["n_tokens"].to_numpy(), group["loss_tokens"].to_numpy(), capacity, *limits(capacity, segments_per, loss_share))
        out = group.drop(columns=["shard", "capacity"])
        out.insert(1, "container_id", [f"s{shard}.{b}" for b in box])
        out["stopped_by"] = [STOPS[stops[b]] for b in box]
        return out

    return run


def limits(capacity: int, segments_per: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> tuple[int, int]:
    """Segments and loss-bearing tokens that a container of this capacity holds at most."""
    return max(1, capacity // segments_per), math.floor(capacity * loss_share)


def pack(documents: DataFrame, id_col: str, text_col: str, capacities: DataFrame, vocabulary: str = VOCABULARY, segments_per: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece_no, n_pieces, first_token, n_tokens, loss_tokens, stopped_by): the container of every text or piece.

    capacities: (capacity_id, capacity_tokens), at most MOST_CAPACITIES rows; each is packed for itself. Texts of up to a capacity are
    one piece; longer ones are cut into pieces of exactly the capacity and a rest. Null, empty and blank texts take part with the
    tokens they have, 0 for null and empty. Limits of a container: capacity tokens, capacity / segments_per segments and loss_share
    of the capacity in loss-bearing tokens; a piece that alone exceeds one of the latter two stands alone. stopped_by, one of STOPS, is
    what closed the container. ids must be unique; repeated rows with one id are packed as texts of their own.
    """
    sizes = [tuple(r) for r in capacities.select("capacity_id", "capacity_tokens").filter("capacity_tokens > 0").limit(MOST_CAPACITIES + 1).collect()]
    if len(sizes) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities in one call")
    counted = materialise(token_counts(documents, id_col, text_col, vocabulary), "tokens")
    shards = max(1, math.ceil(counted.count() / SHARD_ITEMS))
    kinds = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in sizes]) if sizes else F.array().cast("array<struct<capacity_id:int,capacity:bigint>>")
    each = counted.withColumn("c", F.explode(kinds)).select("id", "tokens", "loss", "c.capacity_id", "c.capacity")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    pieces = each.withColumn("n_pieces", n_pieces).withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    first = (F.col("piece_no") - 1) * F.col("capacity")
    n = F.least(F.col("capacity"), F.col("tokens") - first)
    # loss-bearing tokens are the last of the text
    loss = F.least(n, F.greatest(F.lit(0), first + n - (F.col("tokens") - F.col("loss"))))
    pieces = pieces.select("capacity_id", F.col("id").alias("doc_id"), "piece_no", "n_pieces", first.alias("first_token"), n.alias("n_tokens"), loss.alias("loss_tokens"), "capacity", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    full = F.col("n_tokens") == F.col("capacity")
    names = ["capacity_id", "container_id", "doc_id", "piece_no", "n_pieces", "first_token", "n_tokens", "loss_tokens", "stopped_by"]
    own = pieces.filter(full).withColumns({"container_id": F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), F.col("piece_no")), "stopped_by": F.lit("tokens")}).select(*names)
    schema = "capacity_id int, container_id string, doc_id bigint, piece_no int, n_pieces int, first_token bigint, n_tokens bigint, loss_tokens bigint, stopped_by string"
    rest = pieces.filter(~full).groupBy("capacity_id", "shard").applyInPandas(_fill_group(segments_per, loss_share), schema)
    return own.unionByName(rest)
