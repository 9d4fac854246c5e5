"""Where quoted facts stand: in pages, in their parts, across neighbouring parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import doc_id, exact_fact, folded, normal_fact


def evidence(questions: DataFrame) -> DataFrame:
    """(qid, pos, doc_id, source, fact): one row per evidence item, pos from 0; questions without evidence have none."""
    rows = questions.select(F.col("qa_id").alias("qid"), F.posexplode("evidence_list").alias("pos", "e"))
    return rows.select("qid", "pos", doc_id(F.col("e.url")).alias("doc_id"), F.col("e.source").alias("source"), F.col("e.fact").alias("fact"))


#: Facts of one page that are looked for at once.
TOGETHER = 200


def grounded(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """facts(qid, pos, doc_id, fact) with grounded: whether a text of its document, texts(doc_id, text), holds the fact.

    Quotes, dashes, spaces, case and compatibility forms don't count. An empty or null fact is not grounded. Documents meet their facts by
    doc_id, TOGETHER of them at once, and a page fetched more than once counts if any of its texts holds the fact.
    """
    named = facts.withColumn("f", normal_fact(folded(F.col("fact"))))
    asked = named.filter(F.col("f") != "").select("doc_id", "f").distinct()
    asked = asked.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("f")) - 1) / TOGETHER)).groupBy("doc_id", "block").agg(F.collect_list("f").alias("fs"))
    met = texts.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", normal_fact(folded(F.col("text"))).alias("t")).join(asked, "doc_id")
    held = met.select("doc_id", F.explode(F.filter("fs", lambda f: F.contains(F.col("t"), f))).alias("f")).distinct()
    out = named.join(held.withColumn("hit", F.lit(True)), ["doc_id", "f"], "left")
    return out.withColumn("grounded", F.coalesce("hit", F.lit(False))).drop("f", "hit")


def survival(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """facts with place: intact in one of the parts of its document, texts(doc_id, parts), across two neighbours, or absent; case counts."""
    asked = facts.withColumn("f", exact_fact(F.col("fact"))).filter(F.col("f") != "").select("doc_id", "f").distinct()
    parts = texts.select("doc_id", F.transform("parts", exact_fact).alias("ps"))
    met = parts.join(asked, "doc_id")
    intact = F.exists("ps", lambda p: F.contains(p, F.col("f")))
    pairs = F.transform("ps", lambda p, i: F.concat_ws(" ", p, F.get("ps", i + 1)))
    level = F.when(intact, 2).when(F.exists(pairs, lambda p: F.contains(p, F.col("f"))), 1).otherwise(0)
    best = met.groupBy("doc_id", "f").agg(F.max(level).alias("level"))
    out = facts.withColumn("f", exact_fact(F.col("fact"))).join(best, ["doc_id", "f"], "left")
    return out.withColumn("place", F.when(F.col("level") == 2, "intact").when(F.col("level") == 1, "across").otherwise("absent")).drop("f", "level")
