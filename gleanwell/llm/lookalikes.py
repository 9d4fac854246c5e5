"""Texts that look the same but differ in their characters, brought to one form.

A text's plain form is its compatibility decomposition with invisible characters removed, spaces made plain and look-alike letters
of other scripts replaced, composed again. Plain forms are grouped under Spark's UNICODE collation, which keeps case and accents
apart and ignores what ICU ignores; of each group a canonical member is chosen and joined back to all members.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import join_counted, join_split, self_pairs
from ..runtime import BROADCAST_ROWS, materialise

# Letters and marks of other scripts that fonts draw like Latin ones, and the Latin ones.
LOOKALIKES = {
    "аеорсухіѕјһԁԛԝӏ": "aeopcyxisjhdqwl",  # Cyrillic, small
    "АВЕКМНОРСТХІЅЈҮԌԚԜӀ": "ABEKMHOPCTXISJYGQWI",  # Cyrillic, capital
    "ονϳ": "ovj",  # Greek, small
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",  # Greek, capital
    "օհոսցզՕՍ": "ohnugqOU",  # Armenian
    "ɑɡ": "ag",  # phonetic
    "ⲟⲣⲥⲞⲢⲤⲀⲂⲎⲒⲔⲘⲚⲦⲬ": "opcOPCABHIKMNTX",  # Coptic
    "ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴ": "DRTYAJEWMHGZSLCPKB",  # Cherokee
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",  # Lisu
    "‐‑․−⁄∕꞉∶ʼǃ‚∣ǀ∗": "--.-//::'!,||*",  # punctuation
}
# Ranges that are not shown though their category is no format character's.
INVISIBLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]

_GONE = 0x110000
_map: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For every code point the one that stands for it, or _GONE."""
    if not _map:
        to = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            kind = unicodedata.category(c)
            if kind == "Zs":
                to[i] = 0x20
            elif kind == "Cf" or kind == "Cc" and c not in "\t\n":
                to[i] = _GONE
        for a, b in INVISIBLE:
            to[a : b + 1] = _GONE
        for i in (0x0D, 0x85, 0x2028, 0x2029):
            to[i] = 0x0A
        for from_, into in LOOKALIKES.items():
            for a, b in zip(from_, into, strict=True):
                to[ord(a)] = ord(b)
        _map.append(to)
    return _map[0]


def plain(text: str) -> str:
    """The plain form of one text; equal for texts that look the same throughout."""
    if text.isascii() and text.isprintable():
        return text
    parts = unicodedata.normalize("NFKD", text.replace("\r\n", "\n"))
    points = _table()[np.frombuffer(parts.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    points = points[points != _GONE]
    return unicodedata.normalize("NFC", points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))


def _plain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        forms = [plain(t) for t in texts]
        other = [sum(a != b for a, b in zip(t, f)) + abs(len(t) - len(f)) if t != f else 0 for t, f in zip(texts, forms)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(other, pa.int64()), pa.array(forms, pa.string()), batch.column(1)], names=["id", "changed", "form", "text"])


def classes(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cls, canonical, changed, t1, t2) of every record with a text that is not blank.

    cls is the lowest id of the records that look alike, canonical the id of the member whose stored text differs least from its
    plain form, of equal ones the lowest; t1 and t2 identify the stored text; changed counts the places where it differs from its
    plain form. Null, empty and blank texts, those of invisible characters too, are in no class. Repeated rows share a class.
    Texts are taken whole. Only the two columns are read.
    """
    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    forms = rows.mapInArrow(_plain_batches, "id bigint, changed bigint, form string, text string").filter(F.trim(F.regexp_replace("form", r"\s+", " ")) != "")
    keyed = materialise(forms.select("id", "changed", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.xxhash64("form").alias("k1"), F.hash("form").alias("k2"), "form"), "forms")
    first = materialise(keyed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")).select("id", "rows"), "first")
    n, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    distinct = keyed.select("id", "k1", "k2", "form").join(F.broadcast(first) if n <= BROADCAST_ROWS else first, "id")
    alike = Window.partitionBy(F.collate("form", "UNICODE"))
    named = materialise(distinct.select("k1", "k2", "rows", F.min("id").over(alike).alias("cls")), "classes")
    members = join_counted(keyed.drop("form"), named, ["k1", "k2"], "rows", n, total).select("id", "cls", "changed", "t1", "t2")
    best = materialise(members.groupBy("cls").agg(F.min(F.struct("changed", "id")).alias("best"), F.count(F.lit(1)).alias("rows")).select("cls", "rows", F.col("best.id").alias("canonical")), "canonical")
    return materialise(join_counted(members, best, ["cls"], "rows", best.count(), total).select("id", "cls", "canonical", "changed", "t1", "t2"), "members")


def alike_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: records of one class whose stored texts differ.

    Stored texts of a class are paired first, so copies of one text are never compared with each other, however many there are.
    """
    texts = members.groupBy("cls", "t1", "t2").agg(F.min("id").alias("first"))
    texts = materialise(texts, "texts")
    sizes = materialise(texts.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = materialise(join_counted(texts, sizes, ["cls"], "n", n, total), "several")
    met = self_pairs(texts, ["cls"], "first", "n").select("x.cls", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("t1", "t2", "first")])
    for s in "xy":
        side = members.select("cls", F.col("t1").alias(f"{s}t1"), F.col("t2").alias(f"{s}t2"), F.col("id").alias(s))
        met = join_split(materialise(met, "met"), side, ["cls", f"{s}t1", f"{s}t2"], "xfirst" if s == "x" else "x", s)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def with_canonical(records: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """(id, canonical, text): every record with the stored text of its class's canonical member; blank and null texts keep their own."""
    own = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("own")).join(members.select("id", "canonical"), "id", "left")
    theirs = records.select(F.col(id_col).cast("bigint").alias("canonical"), F.col(text_col).alias("theirs"))
    moved = own.filter(F.col("canonical") != F.col("id")).select("id", "canonical").join(theirs, "canonical").select("id", "canonical", F.col("theirs").alias("text"))
    stay = own.filter(F.col("canonical").isNull() | (F.col("canonical") == F.col("id"))).select("id", F.coalesce("canonical", "id").alias("canonical"), F.col("own").alias("text"))
    return stay.unionByName(moved)
