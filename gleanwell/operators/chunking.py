"""Documents into chunks: paragraphs, sentences of long ones, words of long sentences, packed greedily with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_id, strip


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """The stripped, non-empty parts of a text between separators."""
    return F.filter(F.transform(F.split(text, F.lit(rf"\Q{separator}\E"), -1), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts of a text cut behind full stops, question and exclamation marks that white space follows."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: s != "")


def words(text: Column) -> Column:
    """White-space separated words; their number is the default count of tokens."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def _windows(text: Column, most: int) -> Column:
    w = words(text)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))


def units(text: Column, most: int, separator: str = "\n\n") -> Column:
    """Paragraphs, those of over most words as sentences, those of over most words as runs of most words: array<struct<text, n>>."""
    short = lambda x: F.size(words(x)) <= most
    cut = lambda s: F.when(short(s), F.array(s)).otherwise(_windows(s, most))
    parts = F.flatten(F.transform(paragraphs(text, separator), lambda p: F.when(short(p), F.array(p)).otherwise(F.flatten(F.transform(sentences(p), cut)))))
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.size(words(x)).alias("n")))


def _tail(current: Column, overlap: int) -> Column:
    """The last units of a chunk while they fit overlap; the last one always."""
    start = F.struct(F.slice(current, 1, 0).alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def back(s: Column, u: Column) -> Column:
        stop = s["full"] | ((F.size(s["kept"]) > 0) & (s["n"] + u["n"] > overlap))
        return F.struct(F.when(stop, s["kept"]).otherwise(F.array_prepend(s["kept"], u)).alias("kept"), F.when(stop, s["n"]).otherwise(s["n"] + u["n"]).alias("n"), stop.alias("full"))

    return F.aggregate(F.reverse(current), start, back, lambda s: s["kept"])


def pack(u: Column, target: int, most: int, overlap: int) -> Column:
    """Chunks of units: a chunk closes at target words or before a unit that would take it over most; the next begins with its tail.

    The tail is left out if it and the next unit exceed most. array<array<struct<text, n>>>.
    """
    kind = "array<struct<text:string,n:int>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("now"), F.lit(0).alias("n"))
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])

    def step(s: Column, x: Column) -> Column:
        closes = (F.size(s["now"]) > 0) & ((s["n"] >= target) | (s["n"] + x["n"] > most))
        tail = _tail(s["now"], overlap)
        fresh = F.when(size(tail) + x["n"] > most, F.array(x)).otherwise(F.array_append(tail, x))
        return F.struct(
            F.when(closes, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(closes, fresh).otherwise(F.array_append(s["now"], x)).alias("now"),
            F.when(closes, size(fresh)).otherwise(s["n"] + x["n"]).alias("n"),
        )

    return F.aggregate(u, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def chunk(docs: DataFrame, key: str, text: Column, target: int = 300, most: int = 400, overlap: int = 40, separator: str = "\n\n") -> DataFrame:
    """(key, position, chunk_id, text, tokens): the chunks of every document; none crosses documents, null and blank texts have none.

    chunk_id names document, position and text. A single word longer than most is one unit.
    """
    packed = docs.select(key, F.posexplode(pack(units(text, most, separator), target, most, overlap)).alias("position", "us"))
    joined = packed.select(key, "position", F.array_join(F.transform("us", lambda u: u["text"]), separator).alias("text"))
    return joined.select(key, "position", joined_id(F.col(key).cast("string"), F.col("position").cast("string"), F.col("text")).alias("chunk_id"), "text", F.size(words(F.col("text"))).alias("tokens"))
