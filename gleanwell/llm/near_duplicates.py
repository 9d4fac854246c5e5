"""Near-duplicate records: an LSH forest over MinHash signatures, then exact verification.

1. Every record gets a path of LONG MinHash values of its word shingles in each of some trees, a hash of its word sequence and a 128-bit
   sketch. Records with one word sequence are a class; the class's lowest id stands for it, so a hot group of copies is one record.
2. A tree is a trie of the paths, a node being the records that share a prefix. Prefixes start at their full length and are shortened as
   long as the node they lead to stays small, down to SHORT values, where the forest has the target recall for a pair right at the
   threshold. In crowded nodes the longer prefixes stay. What this costs a record in recall is counted from the lengths it has in all its
   trees; a record that would fall below the target has all its nodes shortened after all, and such nodes are met block by block.
3. Records under one leaf meet. A pair leaves the join only if the sketches allow the threshold (four standard deviations of tolerance), so
   a leaf does not emit all its pairs.
4. Every candidate is verified exactly.
5. Verified pairs of classes and the class of every record come out; pairs of records follow by joining both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted, join_split, self_pairs
from ..runtime import BROADCAST_ROWS, materialise
from .words import mix, shingles, word_hashes

#: Trees at least; low thresholds take more of them.
TREES = 64
#: Values of a path, and those that its prefix keeps at least.
LONG, SHORT = 6, 4
#: Records from which a node is crowded.
CROWD = 1_000
SKETCH_BITS = 128
_U = np.uint64


class Links(NamedTuple):
    """members: (id, rep, words), one row per record; pairs: (a, b, similarity) of different reps, a < b; recall: that of a pair right at the
    threshold for the record that has the least, sketches included; trees; crowded: (id, recall) of records with longer prefixes."""

    members: DataFrame
    pairs: DataFrame
    recall: float
    trees: int
    crowded: DataFrame


def trees_for(threshold: float, target: float) -> int:
    """Trees in which a pair of the threshold's similarity shares a path of SHORT values with a chance that misses at most half of what target allows."""
    if threshold >= 1:
        return TREES
    return max(TREES, math.ceil(math.log((1 - target) / 2) / math.log(1 - threshold**SHORT)))


def _sketch_floor(threshold: float) -> int:
    """Equal sketch bits that a pair must have: four standard deviations below what the threshold makes one expect."""
    return int(SKETCH_BITS * (1 + threshold) / 2 - 4 * (SKETCH_BITS * (1 + threshold) * (1 - threshold)) ** 0.5 / 2)


def _sketch_recall(threshold: float) -> float:
    """The chance that a pair right at the threshold has that many equal bits."""
    p, least = (1 + threshold) / 2, _sketch_floor(threshold)
    return 1 - sum(math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k) for k in range(least))


def _signature_batches(size: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240611)
        times = (rng.integers(0, 1 << 32, trees * LONG, dtype=np.uint64) | _U(1)).astype(np.uint32)
        plus = rng.integers(0, 1 << 32, trees * LONG, dtype=np.uint64).astype(np.uint32)
        tree = mix(np.arange(1, trees + 1, dtype=_U))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                part = [t or "" for t in texts[lo : lo + 512]]
                words, at = word_hashes(part)
                counts = np.diff(at)
                runs, run_at = shingles(words, at, size)
                n = len(part)
                place = (np.arange(len(words)) - np.repeat(at[:-1], counts)).astype(_U)
                prints = []
                for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    sums = np.zeros(len(words) + 1, dtype=_U)
                    np.cumsum(mix(words + mix(place + _U(seed))), out=sums[1:])
                    prints.append(mix(sums[at[1:]] - sums[at[:-1]] + counts.astype(_U)))
                has = np.flatnonzero(np.diff(run_at))
                least = np.zeros((n, trees * LONG), dtype=np.uint32)
                if len(has):
                    low, starts = (runs >> _U(32)).astype(np.uint32), run_at[:-1][has]
                    for i in range(trees * LONG):
                        least[has, i] = np.minimum.reduceat(low * times[i] + plus[i], starts)
                paths = least.reshape(n, trees, LONG).astype(_U)
                keys = np.broadcast_to(tree, (n, trees)).copy()
                for k in range(SHORT):
                    keys = mix(keys ^ paths[:, :, k])
                # the rest of the path, in 16 bits for each value
                more = np.zeros((n, trees), dtype=_U)
                for k in range(SHORT, LONG):
                    more = (more << _U(16)) | (mix(paths[:, :, k]) & _U(0xFFFF))
                bits = (mix(least[:, :SKETCH_BITS].astype(_U)) & _U(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(">u8").astype(np.int64)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, n).cast(pa.int64()),
                        pa.array(counts.astype(np.int32)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.array(sketch[:, 0]),
                        pa.array(sketch[:, 1]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(offsets, pa.array(more.astype(np.uint32).view(np.int32).ravel())),
                    ],
                    names=["id", "words", "f1", "f2", "s1", "s2", "keys", "more"],
                )

    return run


def _verify_batches(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts: dict[int, str] = dict(zip(a, batch.column(2).to_pylist()))
            texts |= zip(b, batch.column(3).to_pylist())
            sets: dict[int, np.ndarray] = {}
            names = list(texts)
            for lo in range(0, len(names), 512):
                words, at = word_hashes([texts[x] or "" for x in names[lo : lo + 512]])
                runs, run_at = shingles(words, at, size)
                for k, x in enumerate(names[lo : lo + 512]):
                    sets[x] = np.unique(runs[run_at[k] : run_at[k + 1]])
            out = np.zeros(len(a))
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = sets[x], sets[y]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                out[i] = shared / max(1, len(p) + len(q) - shared)
            keep = pa.array(out >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"]).filter(keep)

    return run


def link(records: DataFrame, id_col: str, text: F.Column, threshold: float = 0.8, shingle: int = 5, target: float = 0.995) -> Links:
    """All pairs of records whose sets of word shingles have a Jaccard similarity of threshold or more, by class of equal texts.

    id_col: a unique bigint; text: the column to compare. Null is the empty text; texts of under shingle words have no shingle and
    join no pair, though equal ones share a class. Texts of any length are taken whole. Repeated rows share a class. Columns other
    than id_col and those of text are not read. An empty table gives empty results. target: the recall of pairs right at the threshold,
    below 1; low thresholds cost many trees (93 at 0.5, 231 at 0.4). A pair of similarity s is missed with a chance of the product of
    1 - s^length over the lengths of prefixes in all trees, (1 - s^4)^trees outside crowded nodes: 0.25 % at 0.5, 1e-14 at 0.8. The
    recall of the record that has the least is in the result; below target it raises. What is found is exact but for 64-bit hash collisions.
    """
    rows = records.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    trees = trees_for(threshold, target)
    schema = "id bigint, words int, f1 bigint, f2 bigint, s1 bigint, s2 bigint, keys array<bigint>, more array<int>"
    signed = materialise(rows.mapInArrow(_signature_batches(shingle, trees), schema), "signatures")
    reps = materialise(signed.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    members = join_counted(signed.select("id", "words", "f1", "f2"), reps, ["f1", "f2"], "copies", *_size(reps, "copies"))
    members = materialise(members.select("id", "rep", "words"), "members")
    copies = members.filter(F.col("id") != F.col("rep")).select("id")
    n = copies.count()
    alone = signed.filter(F.col("words") >= shingle).join(F.broadcast(copies) if n <= BROADCAST_ROWS else copies, "id", "left_anti")
    leaves, crowded, least = _leaves(alone, threshold, trees, target)
    apart = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    met = self_pairs(leaves, ["leaf"], "id", "n", apart <= SKETCH_BITS - _sketch_floor(threshold))
    candidates = materialise(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "candidates")
    found = materialise(_verified(rows, candidates, shingle, threshold), "verified")
    recall = least * _sketch_recall(threshold)
    if recall < target:
        raise ValueError(f"the recall of pairs right at {threshold} is {recall:.6f}")
    return Links(members, found, recall, trees, crowded)


def _leaves(alone: DataFrame, threshold: float, trees: int, target: float) -> tuple[DataFrame, DataFrame, float]:
    """(leaf, id, s1, s2, n) of all records that share a leaf with another, n being its records; (id, recall) of records with longer prefixes; the least recall.

    Nodes at the shortest prefix are counted first; most hold one record, which then takes no further part.
    """
    forest = alone.select(F.explode(F.arrays_zip("keys", "more")).alias("p"), "id", "s1", "s2").select(F.col("p.keys").alias("key"), F.col("p.more").alias("more"), "id", "s1", "s2")
    counts = alone.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    nodes = materialise(counts.filter("n > 1"), "nodes")
    n_nodes, total, most = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shared = join_counted(forest, nodes, ["key"], "n", n_nodes, total)
    whole = 1 - (1 - threshold**SHORT) ** trees
    none = alone.select("id", F.lit(whole).alias("recall")).filter("false")
    if most <= CROWD:
        return shared.select(F.col("key").alias("leaf"), "id", "s1", "s2", "n"), none, whole
    shared = materialise(shared, "shared")
    # prefixes of crowded nodes by length: the shortest of which the node is small, else the longest
    crowd = shared.filter(F.col("n") > CROWD).select("key", "more", "id", "s1", "s2", F.col("n").alias("n_short"))
    longer = {k: F.xxhash64("key", F.lit(k), F.shiftrightunsigned("more", 16 * (LONG - k))) for k in range(SHORT + 1, LONG + 1)}
    leaf, size, length = F.col(f"k{LONG}"), F.col(f"n{LONG}"), F.lit(LONG)
    wide = crowd.withColumns({f"k{k}": c for k, c in longer.items()})
    for k in longer:
        per = materialise(wide.groupBy(f"k{k}").agg(F.count(F.lit(1)).alias(f"n{k}")), "nodes")
        wide = join_counted(wide, per, [f"k{k}"], f"n{k}", *_size(per, f"n{k}"))
    for k in reversed([*longer][:-1]):
        small = F.col(f"n{k}") <= CROWD
        leaf, size, length = (F.when(small, a).otherwise(b) for a, b in ((F.col(f"k{k}"), leaf), (F.col(f"n{k}"), size), (F.lit(k), length)))
    wide = materialise(wide.select("key", "n_short", "id", "s1", "s2", leaf.alias("leaf"), size.alias("n"), length.alias("length")), "crowd")
    lost = lambda k: F.log(1 - F.pow(F.lit(threshold), k)) - math.log(1 - threshold**SHORT)
    recall = 1 - F.exp(F.lit(trees * math.log(1 - threshold**SHORT)) + F.sum(lost(F.col("length"))))
    per_record = materialise(wide.groupBy("id").agg(recall.alias("recall")), "recalls")
    below = per_record.filter(F.col("recall") < target / _sketch_recall(threshold))
    back = materialise(wide.join(below.select("id"), "id", "left_semi").select("key").distinct(), "shortened")
    known = F.broadcast(back) if back.count() <= BROADCAST_ROWS else back
    long_ = wide.join(known, "key", "left_anti").select("leaf", "id", "s1", "s2", "n").filter("n > 1")
    short = wide.join(known, "key", "left_semi").select(F.col("key").alias("leaf"), "id", "s1", "s2", F.col("n_short").alias("n"))
    light = shared.filter(F.col("n") <= CROWD).select(F.col("key").alias("leaf"), "id", "s1", "s2", "n")
    final = wide.join(known, "key", "left_anti").groupBy("id").agg(recall.alias("recall"))
    final = materialise(final, "recalls")
    least = final.agg(F.min("recall")).first()[0]
    return light.unionByName(long_).unionByName(short), final, min(whole, least if least is not None else whole)


def _size(df: DataFrame, count: str) -> tuple[int, int]:
    """Rows of df and the sum of its counts."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first())


def _verified(rows: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """pairs(a, b) that reach the threshold, with similarity; only texts of their ids are moved."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    n = ids.count()
    texts = rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", "left_semi")
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify_batches(shingle, threshold), "a bigint, b bigint, similarity double")


def record_pairs(links: Links, shingle: int) -> DataFrame:
    """(a, b), a < b: all pairs of records, those within a class of equal texts of shingle words and more included; large classes are met in blocks."""
    m = links.members.filter(F.col("words") >= shingle).select("id", "rep")
    sizes = materialise(m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "classes")
    m = materialise(join_counted(m, sizes, ["rep"], "n", *_size(sizes, "n")), "members")
    same = self_pairs(m.filter("n > 1"), ["rep"], "id", "n").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    across = links.pairs.select(F.col("a").alias("rep"), "b")
    across = join_split(across, m.select("rep", F.col("id").alias("x")), "rep", "b", "x").select("x", F.col("b").alias("rep"))
    across = join_split(materialise(across, "half"), m.select("rep", F.col("id").alias("y")), "rep", "x", "y")
    return same.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def groups(links: Links) -> DataFrame:
    """(id, group_id, links): the group of every record, named by its lowest id, and the number of other classes its class is linked to.

    Groups are connected components of the class links: every round a class takes the lowest label among its neighbours' and then
    the label of that label, so chains halve; rounds end when no label changes.
    """
    edges = links.pairs.select("a", "b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = materialise(labels, "labels")
        near = both.join(labels.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").withColumn("near", F.least("label", "near"))
        jump = labels.select(F.col("a").alias("near"), F.col("label").alias("far"))
        step = step.join(jump, "near", "left").select("a", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("old"))
        step = materialise(step, "labels")
        labels = step.select("a", "label")
        if not step.filter(F.col("label") != F.col("old")).limit(1).count():
            break
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    sizes = links.members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    named = sizes.join(labels.join(degree, "a").withColumnRenamed("a", "rep"), "rep", "left")
    named = materialise(named.select("rep", "copies", F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")), "groups")
    return join_counted(links.members, named, ["rep"], "copies", *_size(named, "copies")).select("id", "group_id", "links")
