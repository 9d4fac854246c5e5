"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from . import leakage, lookalikes, near_duplicates, packing, page_body, quota_sample, repeated_lines, split_overlap


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "corpus_documents"), "corpus_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, x) for x in ("phase9_holdout_report", "sample_plans", "sample_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the targets that need more questions than there are."""
    return quota_sample.report(*_plans(spark, sf_dir)).filter("short > 0").select("plan_id", "question_type", "hop_count")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions needed, available and drawn for every cell of the targets."""
    return quota_sample.report(*_plans(spark, sf_dir))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn questions of every plan."""
    return quota_sample.draw(*_plans(spark, sf_dir))


def p1_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the sample by plan and cell."""
    n = p1_sample(spark, sf_dir).groupBy("plan_id", "question_type", "hop_count")
    return n.agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("qa_id").alias("different"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 10 pages of their site hold, and lines of sequences that do."""
    return repeated_lines.repeated_places(repeated_lines.mine(_corpus(spark, sf_dir), longest=2))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its body freed of repeated lines."""
    corpus = _corpus(spark, sf_dir)
    return repeated_lines.without_repeated_lines(corpus, repeated_lines.mine(corpus, longest=2)).select("corpus_id", "clean_body", "removed_lines")


def p2_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that 20 pages of their site hold, or that stand in sequences which 10 pages hold: more than single lines would give."""
    return repeated_lines.repeated_places(repeated_lines.mine(_corpus(spark, sf_dir), 20, 10, longest=2))


def p2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent line sequences by length, but for parts of longer ones that always come with them: how many there are and the pages that hold the commonest."""
    mined = repeated_lines.mine(_corpus(spark, sf_dir))
    return mined.patterns.groupBy("length").agg(F.count(F.lit(1)).alias("patterns"), F.max("docs").alias("most_docs"))


def _article_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages that share at least half of their word triples."""
    links = near_duplicates.link(_corpus(spark, sf_dir), "corpus_id", _article_text(), threshold=0.5, shingle=3)
    return near_duplicates.record_pairs(links, 3).select(F.col("a").alias("corpus_id_a"), F.col("b").alias("corpus_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every page at five words and a similarity of 0.8."""
    links = near_duplicates.link(_corpus(spark, sf_dir), "corpus_id", _article_text())
    return near_duplicates.groups(links).withColumnRenamed("id", "corpus_id")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finding the pairs of p3_found took: trees, the least recall of pairs right at the threshold, records with longer prefixes, linked pairs of classes."""
    links = near_duplicates.link(_corpus(spark, sf_dir), "corpus_id", _article_text(), threshold=0.5, shingle=3)
    classes = links.members.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("rep").alias("classes"))
    crowded, pairs = links.crowded.agg(F.count(F.lit(1)).alias("crowded")), links.pairs.agg(F.count(F.lit(1)).alias("pairs"))
    return classes.crossJoin(crowded).crossJoin(pairs).select("*", F.lit(links.trees).alias("trees"), F.lit(round(links.recall, 3)).alias("least_recall"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page that are not part of its article."""
    return page_body.furniture(_corpus(spark, sf_dir))


def p4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return page_body.articles(_corpus(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.split_questions(spread(table(spark, sf_dir, "qa_records"), "record_id"), table(spark, sf_dir, "benchmark_manifest"), "development", "final_holdout")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids of development and final_holdout whose queries share 0.8 of their words."""
    pairs = split_overlap.overlaps(_questions(spark, sf_dir))
    return pairs.select(F.least("left_key", "right_key").alias("qa_id_a"), F.greatest("left_key", "right_key").alias("qa_id_b")).distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ids and pairs per split and source of the evidence."""
    pairs = split_overlap.overlaps(_questions(spark, sf_dir))
    return split_overlap.counts_by_source(pairs, table(spark, sf_dir, "qa_records"), "development", "final_holdout")


def p5_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of either split by the number of records of the other whose idf-weighted cosine is 0.9 or more."""
    vecs = split_overlap.vectors(_questions(spark, sf_dir), "idf")
    pairs = split_overlap.record_pairs(vecs, split_overlap.class_pairs(vecs, 0.9))
    return pairs.groupBy(F.col("left_key").alias("qa_id")).agg(F.count(F.lit(1)).alias("partners"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece at each capacity."""
    return packing.pack(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "pack_capacities")).drop("stopped_by")


def _filled(packed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, space left over and what closed them at each capacity."""
    boxes = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss"), F.first("stopped_by").alias("stopped_by"))
    sizes = table(spark, sf_dir, "pack_capacities").select("capacity_id", "capacity_tokens")
    stopped = [F.count_if(F.col("stopped_by") == s).alias(f"by_{s}") for s in packing.STOPS]
    totals = boxes.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("segments").alias("most_segments"), F.sum("loss").alias("loss"), *stopped)
    unused = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return totals.join(sizes, "capacity_id").select("capacity_id", "containers", "tokens", "loss", "most_segments", *[f"by_{s}" for s in packing.STOPS], unused.alias("unused"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and space left over at each capacity, and how many containers each limit closed."""
    return _filled(packing.pack(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "pack_capacities")), spark, sf_dir)


def p6_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must keep, counted at each capacity: texts, texts cut though they would fit, missing or doubled pieces, containers over a limit that hold more than one piece."""
    packed = packing.pack(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "pack_capacities"))
    sizes = table(spark, sf_dir, "pack_capacities").select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("cap"))
    texts = packed.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("m"), F.max("n_pieces").alias("of"), F.max("n_tokens").alias("most"))
    per = texts.join(sizes, "capacity_id").groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("cap"))).alias("cut"), F.count_if((F.col("n") != F.col("of")) | (F.col("m") != F.col("of"))).alias("broken"),
    )
    boxes = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum("loss_tokens").alias("loss")).join(sizes, "capacity_id")
    segments, loss = F.greatest(F.lit(1), F.floor(F.col("cap") / packing.TOKENS_PER_SEGMENT)), F.floor(F.col("cap") * packing.LOSS_SHARE)
    over = (F.col("tokens") > F.col("cap")) | (F.col("n") > 1) & ((F.col("n") > segments) | (F.col("loss") > loss))
    return per.join(boxes.groupBy("capacity_id").agg(F.count_if(over).alias("over")), "capacity_id")


def p6_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with an answer by themselves, half of a container's tokens loss-bearing and a segment for 96 tokens at most: what closes containers of instruction data."""
    asked = _documents(spark, sf_dir).filter(F.contains("text", F.lit(packing.ANSWER)))
    return _filled(packing.pack(asked, "doc_id", "text", table(spark, sf_dir, "pack_capacities"), segments_per=96, loss_share=0.5), spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 consecutive words of a held-out passage."""
    hits = leakage.leaks(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_passages"))
    return hits.filter("distance = 0").select(F.col("id").alias("doc_id"), "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages: documents that hold part of them, word for word and within two words."""
    hits = leakage.leaks(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_passages"))
    return hits.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("exact_docs"), F.count(F.lit(1)).alias("near_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose stored texts differ but look alike."""
    pairs = lookalikes.alike_pairs(lookalikes.classes(_documents(spark, sf_dir), "doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text of the canonical member of its class."""
    documents = _documents(spark, sf_dir)
    members = lookalikes.classes(documents, "doc_id", "text")
    return lookalikes.with_canonical(documents, "doc_id", "text", members).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_drawn, p2_found, p2_cleaned, p2_sequences, p2_patterns, p3_found, p3_groups, p3_recall, p4_found, p4_articles, p5_found, p5_counts, p5_idf, p6_pack, p6_fill, p6_valid, p6_instructions, p7_found, p7_items, p8_found, p8_canonical)}
