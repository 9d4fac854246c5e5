"""Samples whose shares of each category match targets: divisor-method priorities over random ranks.

Within each category the records get random ranks; the record of rank r has the priority (r - 0.5) / target share. Records within a
category's minimum go first, then those of the smallest priorities over all categories, until the sample is full. A category that
runs out has no further priorities, so its seats go to the others by themselves. Ranks and the cut are found with spread_rank: random
keys and logarithms of priorities are cut into buckets, so neither a category nor a plan is ever one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_rank
from ..runtime import broadcast_if_small, materialise


def type_key(name: Column) -> Column:
    """A question type without case, spaces, hyphens and underscores; null and names without anything else have none."""
    key = F.regexp_replace(F.lower(name), r"[\s _\-]+", "")
    return F.when(key != "", key)


def population(records: DataFrame) -> DataFrame:
    """(qa_id, type_key, hop_count) without repeated rows, of records that have all three."""
    rows = records.select("qa_id", type_key(F.col("question_type")).alias("type_key"), "hop_count")
    return rows.filter("qa_id IS NOT NULL AND type_key IS NOT NULL AND hop_count IS NOT NULL").distinct()


def _cells(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their plan's size; shares of a plan are scaled to add up to 1. A cell named twice in a plan has its shares and minimums added."""
    t = targets.withColumn("type_key", type_key(F.col("question_type"))).filter("type_key IS NOT NULL AND hop_count IS NOT NULL")
    t = t.groupBy("plan_id", "type_key", "hop_count").agg(F.min("question_type").alias("question_type"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.sum(F.coalesce("min_rows", F.lit(0))).cast("int").alias("min_rows"))
    sums = t.groupBy("plan_id").agg(F.sum("share").alias("all"))
    t = t.join(sums, "plan_id").withColumn("share", F.when(F.col("all") > 0, F.col("share") / F.col("all")).otherwise(F.lit(0.0))).drop("all")
    return t.join(plans.select("plan_id", "sample_size"), "plan_id")


def draw(records: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, question_type, hop_count, qa_id, rank, priority, floor): the sample of every plan.

    records: (qa_id, question_type, hop_count); repeated rows count once, rows with a null in any of them are in no cell; a question
    with rows in two cells can be drawn for both. plans: (plan_id, sample_size), targets: (plan_id, question_type, hop_count,
    target_share, min_rows). Ties of priority go by type and hop count. If the minimums exceed the sample size, those with
    the lowest ranks are taken. A share of 0 gives no seat beyond the minimum. Empty tables give an empty sample; names of further
    columns don't matter. The same seed draws the same sample whatever the partitioning.
    """
    return _seated(_ranked(records, plans, targets, seed))


def _ranked(records: DataFrame, plans: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The candidates of every cell with rank, floor and priority: all ranks that the plan could seat."""
    cells = materialise(_cells(plans, targets), "cells")
    rows = population(records).join(broadcast_if_small(cells, cells.count()), ["type_key", "hop_count"])
    rows = rows.withColumn("random", F.xxhash64(F.lit(seed), "plan_id", "type_key", "hop_count", "qa_id"))
    ranked = spread_rank(rows, ["plan_id", "type_key", "hop_count"], [F.col("random"), F.col("qa_id")], F.shiftright("random", 54), "rank")
    ranked = ranked.filter(F.col("rank") <= F.greatest("sample_size", "min_rows"))
    ranked = ranked.withColumn("floor", F.col("rank") <= F.col("min_rows")).withColumn("priority", F.when(F.col("share") > 0, (F.col("rank") - 0.5) / F.col("share")))
    return materialise(ranked.filter(F.col("floor") | F.col("priority").isNotNull()), "ranked")


def _seated(ranked: DataFrame) -> DataFrame:
    # floors by rank, then priorities by their logarithm, 256 buckets for a doubling
    step = lambda x: F.floor(F.log2(x) * 256)
    bucket = F.when(F.col("floor"), step(F.col("rank"))).otherwise(step(F.col("priority")) + F.lit(1 << 20)).cast("bigint")
    order = [F.when(F.col("floor"), F.col("rank").cast("double")).otherwise(F.col("priority")), F.col("type_key"), F.col("hop_count"), F.col("rank")]
    seats = spread_rank(ranked, ["plan_id"], order, bucket, "seat").filter(F.col("seat") <= F.col("sample_size"))
    return seats.select("plan_id", "question_type", "hop_count", "qa_id", F.col("rank").cast("bigint"), "priority", "floor")


def report(records: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, question_type, hop_count, needed, available, drawn, short): one row per cell of every plan.

    needed is the larger of min_rows and the cell's share of the sample size, a part of a question counting as one, short how many questions it lacks of that:
    the ranks it asks for beyond its last one. available counts the cell's questions on their own.
    """
    sizes = population(records).groupBy("type_key", "hop_count").agg(F.count(F.lit(1)).alias("available"))
    ranked = _ranked(records, plans, targets, seed)
    last = ranked.groupBy("plan_id", "type_key", "hop_count").agg(F.max("rank").cast("bigint").alias("last"))
    drawn = _seated(ranked).groupBy("plan_id", type_key(F.col("question_type")).alias("type_key"), "hop_count").agg(F.count(F.lit(1)).alias("drawn"))
    out = _cells(plans, targets).join(sizes, ["type_key", "hop_count"], "left").join(drawn, ["plan_id", "type_key", "hop_count"], "left").join(last, ["plan_id", "type_key", "hop_count"], "left")
    needed = F.greatest(F.col("min_rows").cast("bigint"), F.ceil(F.round(F.col("share") * F.col("sample_size"), 6)))
    out = out.withColumn("needed", needed).withColumn("available", F.coalesce("available", F.lit(0)))
    short = F.greatest(F.col("needed") - F.coalesce("last", F.lit(0)), F.lit(0))
    return out.select("plan_id", "question_type", "hop_count", "needed", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), short.alias("short"))
