"""Lines that pages of one site carry over and over: PrefixSpan over line identifiers, then deletion.

Lines become identifiers of (site, letters); a page becomes the sequence of its frequent ones, which is kept once, and a pattern's projected
page is a pointer to where an occurrence ends in it. Every round joins the pointers with the pages, appends to each pattern every
line that comes within MAX_GAP + 1 places behind the pointer, so up to MAX_GAP other frequent lines may stand between two lines of a
sequence, counts the pages of each longer pattern and goes on with the frequent ones until none is left. A pattern's
support is its number of pages, so every prefix of a frequent pattern is frequent too.

Two prunings keep always-together lines from multiplying: where one line comes directly behind every occurrence of a pattern, the pattern
grows by that line alone, as skipping it changes neither pages nor what follows; and a line that always stands directly behind the
same other line starts no pattern. What they leave out are parts of longer patterns with the same support. Pointers are rows of a fixed
size; only counts and numbers of patterns reach the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import join_counted
from ..runtime import materialise
from .sites import line_keys, site_of

MIN_DOCS = 10
#: Other frequent lines of a page that may stand between two lines of a sequence.
MAX_GAP = 1


class Mined(NamedTuple):
    """patterns: (pattern, length, docs); occurrences: (corpus_id, pattern, length, first, last), one row each, first and last being line numbers."""

    patterns: DataFrame
    occurrences: DataFrame


def mine(corpus: DataFrame, line_docs: int = MIN_DOCS, sequence_docs: int = MIN_DOCS, max_gap: int = MAX_GAP, longest: int | None = None) -> Mined:
    """Frequent line sequences of every site of corpus(corpus_id, url, source, body) and all their occurrences.

    line_docs, sequence_docs: pages of a site that must hold a single line, or a sequence of two lines and more, at least.
    Null and empty bodies hold no lines, lines without letters count nowhere, a line twice in a page counts once for its support.
    A null url falls back on source. Repeated rows are pages of their own. Other columns are not read. Empty input: no patterns.
    Sequences have any length; there are as many rounds as the longest frequent one has lines. longest ends the growth earlier and
    prunes nothing: with 2, sequences of two lines come out whole, and as two neighbours in a frequent sequence are one themselves,
    these cover every line that any longer sequence covers.
    """
    least = min(line_docs, sequence_docs)
    pages = corpus.select("corpus_id", site_of(F.col("url"), F.col("source")).alias("site"), line_keys(F.col("body")).alias("keys")).filter(F.col("keys").isNotNull())

    def hashed(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.filter(F.col("key") != "").select(*keep, F.xxhash64("site", "key").alias("line"), F.hash("key", "site").alias("check"))

    counts = hashed(pages.select("site", F.explode(F.array_distinct("keys")).alias("key"))).groupBy("line", "check").agg(F.count(F.lit(1)).alias("docs"))
    single = materialise(counts.filter(F.col("docs") >= least), "lines")
    lines = hashed(pages.select("corpus_id", "site", F.posexplode("keys").alias("pos", "key")), "corpus_id", F.col("pos").cast("int"))
    found = join_counted(lines, single, ["line", "check"], "docs", *_size(single)).select("corpus_id", (F.col("pos") + 1).alias("pos"), "line", "docs")
    page = Window.partitionBy("corpus_id").orderBy("pos", "line")
    ahead = F.array_compact(F.array(*[F.lead(F.struct("line", "pos"), k).over(page) for k in range(1, max_gap + 3)]))
    steps = materialise(found.select("corpus_id", F.row_number().over(page).alias("at"), "line", "pos", "docs", F.lag("line").over(page).alias("behind"), ahead.alias("ahead")), "pages")
    patterns = [single.filter(F.col("docs") >= line_docs).select(F.col("line").alias("pattern"), F.lit(1).alias("length"), "docs")]
    occurrences = [steps.filter(F.col("docs") >= line_docs).select("corpus_id", F.col("line").alias("pattern"), F.lit(1).alias("length"), F.col("pos").alias("first"), F.col("pos").alias("last"))]
    # lines that start patterns, and whether one line comes behind all their places
    starts = steps.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), *_always("behind", F.col("behind")), *_always("next", F.get("ahead", F.lit(0))["line"]))
    starts = starts if longest is None else starts.withColumns({"behind": F.lit(False), "next": F.lit(False)})
    starts = materialise(starts.filter("NOT behind").select(F.col("line").alias("pattern"), "next", "docs"), "starts")
    level = join_counted(steps.select("corpus_id", F.col("line").alias("pattern"), "at", F.col("pos").alias("first")), starts, ["pattern"], "docs", *_size(starts)).drop("docs")
    length, ways = 1, steps.select("corpus_id", "at", "ahead")
    while longest is None or length < longest:
        length += 1
        reach = F.when(F.col("next"), 1).otherwise(max_gap + 1)
        nexts = F.transform(F.slice("ahead", F.lit(1), reach), lambda x, i: F.struct(x["line"].alias("line"), x["pos"].alias("last"), (i + 1).alias("step"), F.get("ahead", i + 1)["line"].alias("after")))
        longer = level.join(ways, ["corpus_id", "at"]).select("corpus_id", "pattern", "at", "first", F.explode(nexts).alias("n"))
        longer = longer.select("corpus_id", F.xxhash64("pattern", "n.line", F.lit(length)).alias("pattern"), (F.col("at") + F.col("n.step")).alias("at"), "first", "n.last", "n.after")
        longer = materialise(longer.dropDuplicates(["corpus_id", "pattern", "at", "first"]), "longer")
        per_page = longer.groupBy("pattern", "corpus_id").agg(F.count(F.lit(1)).alias("rows"), F.count("after").alias("some"), F.min("after").alias("least"), F.max("after").alias("most"))
        support = per_page.groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("docs"), ((F.sum("rows") == F.sum("some")) & (F.min("least") == F.max("most"))).alias("next"))
        frequent = materialise(support.filter(F.col("pages") >= sequence_docs).select("pattern", F.coalesce("next", F.lit(False)).alias("next"), "pages", "docs"), "sequences")
        rows, total = _size(frequent)
        if not rows:
            break
        patterns.append(frequent.select("pattern", F.lit(length).alias("length"), F.col("pages").alias("docs")))
        level = materialise(join_counted(longer, frequent, ["pattern"], "docs", rows, total).select("corpus_id", "pattern", "at", "first", "last", "next"), "occurrences")
        occurrences.append(level.select("corpus_id", "pattern", F.lit(length).alias("length"), "first", "last"))
    return Mined(reduce(DataFrame.unionByName, patterns), reduce(DataFrame.unionByName, occurrences))


def _always(name: str, value: F.Column) -> list[F.Column]:
    """Whether value is the same and never null throughout a group."""
    return [F.coalesce((F.count(value) == F.count(F.lit(1))) & (F.min(value) == F.max(value)), F.lit(False)).alias(name)]


def _size(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first())


def repeated_places(mined: Mined) -> DataFrame:
    """(corpus_id, line_no): every line, numbered from 1, that stands in an occurrence of a frequent sequence; no row twice.

    A prefix of an occurrence is an occurrence of its own, so first and last lines of all of them are all their lines.
    """
    ends = mined.occurrences.select("corpus_id", F.explode(F.array("first", "last")).alias("line_no"))
    return ends.select("corpus_id", F.col("line_no").cast("bigint")).distinct()


def without_repeated_lines(corpus: DataFrame, mined: Mined) -> DataFrame:
    """corpus with clean_body (body without the mined places, other lines as they were) and removed_lines.

    A null body stays null with 0 removed lines; a body of which all lines go becomes ''. All columns of corpus are kept.
    """
    cut = repeated_places(mined).groupBy(F.col("corpus_id").alias("__cut_id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("__cut"))
    joined = corpus.join(cut, F.col("corpus_id") == F.col("__cut_id"), "left")
    lines = F.split("body", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no"))), lambda x: ~F.array_contains(F.col("__cut"), x["no"]))
    clean = F.when(F.col("__cut").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return joined.withColumn("clean_body", clean).withColumn("removed_lines", F.coalesce(F.size("__cut"), F.lit(0))).drop("__cut_id", "__cut")
