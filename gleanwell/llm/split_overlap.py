"""Records of one split that come again, in the same or nearly the same words, in another: a weighted cosine join.

Every text is a unit vector of term weights, its terms ordered by rarity over both splits. Let top be a vector's largest weight and
rest the norm of what follows a term. Two vectors with m - 1 common terms before that place have a product of at most
sqrt((m - 1) top^2 + rest^2), so as soon as this is below the threshold no later term is posted: vectors that reach the threshold share
m terms at least among those that both have posted. The inverted lists are therefore kept by groups of m posted terms, pairs unless
asked otherwise, which makes them short where single terms are frequent. (A vector that fewer terms can carry over the threshold is
posted whole, by smaller groups too.) Lists by pairs grow with the records of a subject; by threes there are some five times as
many postings, and lists grow only with records that share three rare terms. The lists of the two
splits are joined; each posting carries a 64-bit map of the vector's terms, and a joined pair goes on only if the norms of what the
maps leave in common still allow the threshold. Survivors get their exact dot product. Equal sets of words are one class, so copies
are neither posted nor compared again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import join_counted
from ..runtime import BROADCAST_ROWS, materialise

#: Room for rounding in sums of doubles.
EPSILON = 1e-6


class Vectors(NamedTuple):
    """members: (key, cls, left, right); classes: (cls, left, right, text), both without repeated rows; terms: (term, df); and the numbers behind them."""

    members: DataFrame
    classes: DataFrame
    terms: DataFrame
    n_classes: int
    n_terms: int
    total: int
    weighting: str


def terms_of(text: Column) -> Column:
    """The distinct words of a text, a word being a longest run of letters and digits after lower-casing; null and empty have none."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))


def _hashed(text: Column) -> Column:
    return F.array_sort(F.transform(terms_of(text), lambda w: F.xxhash64(w)))


def vectors(records: DataFrame, weighting: str = "binary") -> Vectors:
    """Classes, members and term frequencies of records(key, left, right, text); left and right say in which split a record is.

    A class is a set of words and its cls their hash. weighting: "binary", or "idf" with ln(1 + classes / df). Texts without a word,
    null ones among them, belong to no class. Repeated rows count once. Other columns are not read.
    """
    rows = records.select("key", "left", "right", "text", F.xxhash64(_hashed(F.col("text"))).alias("cls")).filter(F.size(terms_of(F.col("text"))) > 0)
    rows = materialise(rows, "texts")
    classes = materialise(rows.groupBy("cls").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"), F.min("text").alias("text")), "classes")
    df = materialise(classes.select(F.explode(_hashed(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    n_terms, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    return Vectors(rows.select("key", "cls", "left", "right").distinct(), classes, df, classes.count(), n_terms, total, weighting)


def _weighted(vecs: Vectors, classes: DataFrame) -> DataFrame:
    """(cls, left, right, df, term, raw): the weighted terms of classes."""
    spread = classes.select("cls", "left", "right", F.explode(_hashed(F.col("text"))).alias("term"))
    raw = F.lit(1.0) if vecs.weighting == "binary" else F.log(1 + F.lit(float(vecs.n_classes)) / F.col("df"))
    return join_counted(spread, vecs.terms, ["term"], "df", vecs.n_terms, vecs.total).select("cls", "left", "right", "df", "term", raw.alias("raw"))


def _postings(vecs: Vectors, threshold: float, together: int) -> DataFrame:
    """(key, cls, left, right, map, least): one row per group of posted terms; least is the smallest squared weight."""
    by = Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("term"))
    whole, later = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("raw") * F.col("raw")
    bit = F.expr("shiftleft(1L, cast(pmod(term, 64) as int))")
    rows = _weighted(vecs, vecs.classes).select(
        "cls", "left", "right", "df", "term", square.alias("own"),
        F.sum(square).over(whole).alias("norm"), F.coalesce(F.sum(square).over(later), F.lit(0.0)).alias("rest"),
        F.max(square).over(whole).alias("top"), F.min(square).over(whole).alias("least"), F.bit_or(bit).over(whole).alias("map"),
    )
    # rest and own make what the term and all later ones hold; below the threshold nothing more is posted
    kept = rows.filter((together - 1) * F.col("top") + F.col("own") + F.col("rest") >= (threshold * threshold - EPSILON) * F.col("norm"))
    posted = kept.groupBy("cls").agg(
        F.first("left").alias("left"), F.first("right").alias("right"), F.first("map").alias("map"), F.first(F.col("least") / F.col("norm")).cast("float").alias("least"),
        F.first(F.ceil((threshold * threshold - EPSILON) * F.col("norm") / F.col("top"))).alias("fewest"), F.array_sort(F.collect_list("term")).alias("t"),
    )
    groups = {1: F.transform("t", lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i")))}
    for m in range(2, together + 1):
        longer = lambda g: F.transform(F.slice("t", g["i"] + 2, F.size("t")), lambda y, k: F.struct(F.xxhash64(g["h"], y).alias("h"), (g["i"] + 1 + k).alias("i")))  # noqa: B023, E731
        groups[m] = F.flatten(F.transform(groups[m - 1], longer))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    sized = [groups[m] if m == together else F.when(F.col("fewest") <= m, groups[m]).otherwise(none) for m in groups]
    keys = F.transform(F.concat(*sized), lambda g: g["h"])
    return posted.select(F.explode(keys).alias("key"), "cls", "left", "right", "map", "least")


def class_pairs(vecs: Vectors, threshold: float, together: int = 2) -> DataFrame:
    """(a, b, dot, shared, n_a, n_b): classes a of the left and b of the right split with a dot product of threshold or more.

    A class that both splits have is paired with itself. shared counts the common terms, n_a and n_b the terms.
    together: how many posted terms name an inverted list; the result is the same for any.
    """
    posted = _postings(vecs, threshold, together)
    a = posted.filter("left").select("key", *[F.col(c).alias(f"{c}_a") for c in ("cls", "map", "least")])
    b = posted.filter("right").select("key", *[F.col(c).alias(f"{c}_b") for c in ("cls", "map", "least")])
    lost_a = F.bit_count(F.col("map_a").bitwiseAND(F.bitwise_not("map_b"))) * F.col("least_a")
    lost_b = F.bit_count(F.col("map_b").bitwiseAND(F.bitwise_not("map_a"))) * F.col("least_b")
    possible = (lost_a < 1) & (lost_b < 1) & ((1 - lost_a) * (1 - lost_b) >= threshold * threshold - EPSILON)
    met = a.join(b, (a["key"] == b["key"]) & possible).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    alive = materialise(met.distinct(), "candidates")
    ids = materialise(alive.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ids")
    n = ids.count()
    needed = vecs.classes.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "cls", "left_semi")
    full = _weighted(vecs, needed).groupBy("cls").agg(F.collect_list("term").alias("t"), F.collect_list("raw").alias("w"))
    left, right = (full.select(F.col("cls").alias(c), F.col("t").alias(f"t{c}"), F.col("w").alias(f"w{c}")) for c in ("a", "b"))
    both = alive.join(left, "a").join(right, "b")
    at = lambda x: F.array_position("tb", x["ta"]).cast("int")
    product = F.aggregate(F.arrays_zip("ta", "wa"), F.lit(0.0), lambda s, x: s + F.when(at(x) > 0, x["wa"] * F.get("wb", at(x) - 1)).otherwise(0.0))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    out = both.select("a", "b", (product / (norm("wa") * norm("wb"))).alias("dot"), F.size(F.array_intersect("ta", "tb")).alias("shared"), F.size("ta").alias("n_a"), F.size("tb").alias("n_b"))
    return out.filter(F.col("dot") >= threshold - EPSILON)


def record_pairs(vecs: Vectors, pairs: DataFrame) -> DataFrame:
    """(left_key, right_key) of all records of the paired classes; no row twice."""
    m = vecs.members
    left = pairs.select("a", "b").join(m.filter("left").select(F.col("cls").alias("a"), F.col("key").alias("left_key")), "a")
    return left.join(m.filter("right").select(F.col("cls").alias("b"), F.col("key").alias("right_key")), "b").select("left_key", "right_key").distinct()


def split_questions(qa: DataFrame, manifest: DataFrame, left: str, right: str) -> DataFrame:
    """(key, left, right, text): the ids that any release lists under either split, with their queries.

    Repeated records give repeated rows; an id that both splits list has a further row without a text, whether it has a record or not.
    """
    listed = manifest.filter(F.col("split").isin(left, right)).select(F.explode("qa_ids").alias("key"), (F.col("split") == left).alias("left"))
    flags = materialise(listed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right")), "listed")
    n = flags.count()
    texts = qa.select(F.col("qa_id").alias("key"), F.col("query").alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(flags) if n <= BROADCAST_ROWS else flags, "key").select("key", "left", "right", "text")
    none = flags.filter(F.col("left") & F.col("right")).select("key", "left", "right", F.lit(None).cast("string").alias("text"))
    return found.unionByName(none)


def overlaps(questions: DataFrame, share: float = 0.8) -> DataFrame:
    """(left_key, right_key): ids of either split whose texts share at least share of their distinct words, shared over words in either.

    With unit weights that needs a product of 2 * share / (1 + share) at least, so the join runs at that and the share is checked
    on its exact counts. An id in both splits is paired with itself even without a text.
    """
    vecs = vectors(questions, "binary")
    pairs = class_pairs(vecs, 2 * share / (1 + share)).filter(F.col("shared") >= share * (F.col("n_a") + F.col("n_b") - F.col("shared")) - EPSILON)
    own = questions.filter(F.col("left") & F.col("right")).select(F.col("key").alias("left_key"), F.col("key").alias("right_key"))
    return record_pairs(vecs, pairs).unionByName(own).distinct()


def counts_by_source(pairs: DataFrame, qa: DataFrame, left: str, right: str) -> DataFrame:
    """(split, source, ids, pairs): per split and evidence source, the overlapping ids and their pairs; source is null without evidence."""
    sources = qa.select(F.col("qa_id").alias("id"), F.explode_outer("evidence_list.source").alias("source")).distinct()
    sides = pairs.select(F.explode(F.array(F.struct(F.lit(left).alias("split"), F.col("left_key").alias("id")), F.struct(F.lit(right).alias("split"), F.col("right_key").alias("id")))).alias("x"))
    per_id = sides.groupBy("x.split", "x.id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.join(sources, "id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("pairs"))
