"""Sliding-window rate limiting per client, on tables and on streams.

An event is let through if fewer than limit events of its client were let through in the window before it; a refused event
does not count. What is let through depends only on events since the last silence of a window or more, so a table is cut into such
stretches first, whose sorted rows pass through Python one by one; a table and a stream alike keep only the times that were let
through, limit of them at most, as their state, so a stretch of any length takes constant memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LIMIT, SECONDS = 5, 60.0


#: Windows that a slot of time is long; a client's rows are ordered slot by slot, so a busy client takes many tasks.
SLOT = 50


def _stretches(rows: DataFrame, client: str, key: str, gap: int) -> DataFrame:
    """rows with __stretch: the time of the last event of the client, this one included, before which it was silent for over gap."""
    rows = rows.withColumn("__slot", F.floor(F.col("__us") / (SLOT * gap)))
    slot, slots = [client, "__slot"], Window.partitionBy(client).orderBy("__slot")
    within = Window.partitionBy(*slot).orderBy("__us", key)
    ends = rows.groupBy(*slot).agg(F.max("__us").alias("__hi")).select(*slot, F.lag("__hi").over(slots).alias("__before"))
    before = F.coalesce(F.lag("__us").over(within), F.col("__before"))
    flagged = rows.join(ends, slot).withColumn("__start", F.when(before.isNull() | (F.col("__us") - before > gap), F.col("__us")))
    starts = flagged.groupBy(*slot).agg(F.max("__start").alias("__last"))
    carried = starts.select(*slot, F.last("__last", True).over(slots.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = F.max("__start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("__own", own).join(carried, slot).withColumn("__stretch", F.coalesce("__own", "__carried"))


def _settle_batches(limit: int, gap: int):
    """Adds allowed to batches of (client, time, key, us, stretch), sorted by client, stretch and us."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, deque()
        for batch in batches:
            allowed = []
            for client, stretch, us in zip(*(batch.column(i).to_pylist() for i in (0, 4, 3))):
                if (client, stretch) != now:
                    now, recent = (client, stretch), deque()
                # a hit exactly one window old still counts
                while recent and us - recent[0] > gap:
                    recent.popleft()
                allowed.append(len(recent) < limit)
                if allowed[-1]:
                    recent.append(us)
            columns = [*batch.columns[:3], pa.array(allowed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:3], "allowed"])

    return run


def limited(events: DataFrame, client: str, time: str, key: str, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """events(client, time, key) with allowed. Ties of time go by key; rows with a null client or time are dropped.

    A client's rows are spread over slots of time; only a stretch without a silence, whose events depend on each other one by one,
    is settled in one task, which sorts its rows (on disk if need be) and reads them once.
    """
    rows = events.filter(F.col(client).isNotNull() & F.col(time).isNotNull()).select(client, key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("__us"))
    gap = int(seconds * 1_000_000)
    stretch = _stretches(rows, client, key, gap)
    stretch = stretch.select(client, time, key, "__us", "__stretch").repartition(client, "__stretch").sortWithinPartitions(client, "__stretch", "__us", key)
    kinds = dict(events.dtypes)
    return stretch.mapInArrow(_settle_batches(limit, gap), f"`{client}` {kinds[client]}, `{time}` {kinds[time]}, `{key}` {kinds[key]}, allowed boolean")


def _settle(limit: int, seconds: float):
    gap = int(seconds * 1_000_000)

    def run(client: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # silent for a window: nothing that it did counts any more
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "key"])
        allowed = []
        for us in rows["us"]:
            recent = [t for t in recent if us - t <= gap]
            allowed.append(len(recent) < limit)
            if allowed[-1]:
                recent.append(int(us))
        state.update((recent,))
        last = int(rows["us"].iloc[-1])
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": client[0], "key": rows["key"], "allowed": allowed})

    return run


def limited_stream(events: DataFrame, client: str, time: str, key: str, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """(client, key, allowed) of a streaming DataFrame whose events come in order of time for each client; client and key are read as bigints.

    The watermark trails by a window. A client's state, limit times at most, goes when the watermark is a window past its last event.
    """
    rows = events.filter(F.col(client).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(client).cast("bigint").alias("client"), F.col(key).cast("bigint").alias("key"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", f"{int(seconds)} seconds").select("client", "key", "at", F.unix_micros("at").alias("us"))
    return rows.groupBy("client").applyInPandasWithState(_settle(limit, seconds), "client bigint, key bigint, allowed boolean", "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
