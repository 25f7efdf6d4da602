"""Near copies by SimHash, held to the Jaccard similarity of their word shingles: the near-duplicate stage of pipelines.

Candidates are found by the bit-sliced SimHash search of `simhash` over the same five-word shingles. Its radius of 4 bits
ends at a similarity of about 0.96: at 0.8 two fingerprints differ in 9.7 bits on average, and a radius that caught nearly
all of those pairs (17 bits) leaves its pigeonhole pieces of under four bits each, which select nothing. So the pairs
between 0.8 and that are found by BANDS min-hash bands of ROWS rows besides: a pair of similarity 0.8 is missed with a
chance of 7e-6, a nearer one with less. Candidates are chained into groups, and within a group every pair not yet joined is decided by its
whole shingle sets, not by an estimate. A large group is dealt into pairs of chunks, so no task holds a whole group; only a
spanning star of each block's links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.common import keep, looked_up, own_text, partitions
from driftline.llm.simhash import bit_counts, components, labelled, majority

SEED, SHINGLE, BANDS, ROWS = 42, 5, 30, 5
#: The least similarity that links, as a fraction of whole numbers.
LEAST = (4, 5)
#: Sets and shingles that a chunk of a group holds on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Sets from which a block first compares so many min-hashes, and the share that must agree: 0.8 is 7 deviations above it.
SKETCH_FROM, SKETCH, SKETCH_LEAST = 16, 64, 0.45

_DRAW = np.random.default_rng(SEED)
FACTORS, SHIFTS = _DRAW.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS = FACTORS * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def min_hashes(found: np.ndarray, n: int = BANDS * ROWS, at_once: int = 1 << 12) -> np.ndarray:
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), at_once):
        part = found[i : i + at_once]
        np.minimum(least, (part[None, :] * FACTORS[:n, None] + SHIFTS[:n, None]).min(axis=1), out=least)
    return least


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles; 0 without any."""
    counts = sum((bit_counts(found[i : i + simhash.AT_ONCE]) for i in range(0, len(found), simhash.AT_ONCE)), np.zeros(64, np.int64))
    return majority(counts, len(found))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return common * LEAST[1] >= LEAST[0] * (len(a) + len(b) - common)


def joined(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first index of its component over pairs that are alike."""
    n, label = len(sets), np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    sketch = np.array([min_hashes(s, SKETCH) for s in sets]) if n >= SKETCH_FROM else None
    for i in range(n - 1):
        open_ = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) * LEAST[1] >= LEAST[0] * np.maximum(size[i + 1 :], size[i]))
        js = i + 1 + np.flatnonzero(open_)
        if sketch is not None and len(js):
            js = js[(sketch[js] == sketch[i]).sum(axis=1) >= SKETCH * SKETCH_LEAST]
        for j in js.tolist():
            if label[j] != label[i] and alike(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (a hash of the shingle set), fp (its SimHash), bands (their keys) of every row; no words, no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, bands = [], [], []
            for text in b.column(1).to_pylist():
                found = shingles(text)
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                fps.append(fingerprint(found))
                least = min_hashes(found).reshape(BANDS, ROWS) if len(found) else ()
                bands.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)], np.uint64).view(np.int64))
            ids, fps = (pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (ids, fps))
            yield pa.record_batch([b.column(0), ids, fps, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "set_id", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, set_id long, fp long, bands array<long>")


#: Bits of the marks that leave out most sets that are nobody's candidate before they are sent: 2 MB at any size of the input.
MARK_BITS = 1 << 24


def marks_of(ids: DataFrame, key: str) -> np.ndarray:
    """Marks, a bit for each value of the low bits of an id; what has no mark is not among the ids. MARK_BITS / 64 numbers at most
    reach the driver."""
    low = F.col(key).bitwiseAND(MARK_BITS - 1)
    found = ids.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(low & 63 AS INT))".replace("low", f"`{key}`"))).alias("bits")).collect()
    out = np.zeros(MARK_BITS // 64, np.uint64)
    if found:
        out[[r.word for r in found]] = np.array([r.bits for r in found], np.int64).view(np.uint64)
    return out


def sets(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """set_id, n, shingles (8 bytes each) of each batch's distinct sets that are marked, so that a text of many copies is one row a
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for text in dict.fromkeys(b.column(0).to_pylist()):
                data = shingles(text).tobytes()
                i = xxhash.xxh64_intdigest(data, SEED)
                if int(marks[(i & MARK_BITS - 1) >> 6]) >> (i & 63) & 1:
                    found[i] = data
            ids = np.array(list(found), np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(x) // 8 for x in found.values()], pa.int64()), pa.array(list(found.values()), pa.binary())], names=["set_id", "n", "shingles"])

    return docs.select(own_text().alias("text")).mapInArrow(run, "set_id long, n long, shingles binary")


def sketched(own: DataFrame) -> DataFrame:
    """(a, b): edges that chain the set_ids whose SimHashes are within simhash.RADIUS. A fingerprint that links, or that sets
    share, is a node of its own (a hash of it), so a hot one is nobody's join key."""
    rows = own.where(F.size("bands") > 0).select("fp", "set_id").distinct()
    node = F.xxhash64(F.lit("fp"), F.col("fp"))
    classes = keep(rows.groupBy("fp").agg(F.count("*").alias("n")), "sketches")
    near = keep(simhash.links(classes.select("fp")), "near")
    linked = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    nodes = classes.where("n > 1").unionByName(classes.join(linked, "fp", "left_semi")).distinct().withColumn("node", node)
    members = looked_up(rows, "fp", keep(nodes, "nodes"), "node").where("node IS NOT NULL")
    edge = [F.xxhash64(F.lit("fp"), F.col(c)).alias(c) for c in ("a", "b")]
    return near.select(*edge).union(members.select(F.col("node").alias("a"), F.col("set_id").alias("b")))


def links(docs: DataFrame, own: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between set_ids that join the same ones as all candidates that are alike."""
    rows = own.select("set_id", F.explode("bands").alias("key")).distinct()
    low = rows.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("key", "low")
    banded = rows.join(low, "key").where("set_id <> low").select(F.col("low").alias("a"), F.col("set_id").alias("b"))
    chained = components(banded.union(sketched(own)).distinct(), "chained")
    groups = keep(chained.union(chained.select(F.col("root").alias("node"), "root").distinct()), "groups")
    found = sets(docs, marks_of(groups, "node")).join(groups.withColumnRenamed("node", "set_id"), "set_id").groupBy("root", "set_id").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    found = keep(found, "sets")
    chunks = F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = found.groupBy("root").agg(chunks.alias("chunks")).where("chunks > 1")
    dealt = found.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    dealt = dealt.select("set_id", "shingles", "root", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("set_id", "shingles", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: dict[int, bytes]) -> pa.RecordBatch:
            ids = np.array(sorted(held), np.int64)
            label = joined([np.frombuffer(held[i], np.uint64) for i in ids.tolist()])
            member = np.flatnonzero(label != np.arange(len(ids)))
            return pa.record_batch([pa.array(ids[label[member]], pa.int64()), pa.array(ids[member], pa.int64())], names=["a", "b"])

        open_block, held = None, {}  # the rows come sorted by block; one block is held at a time
        for batch in batches:
            for i, data, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != open_block:
                    if len(held) > 1:
                        yield solve(held)
                    open_block, held = at, {}
                held[i] = data
        if len(held) > 1:
            yield solve(held)

    return dealt.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text; other columns are left).

    component_id is the smallest doc_id reachable over pairs of texts with a similarity of LEAST or more; texts without
    words are copies of one another. A null doc_id stays null and never becomes a component_id unless its component has no
    other. Repeated rows stay repeated.
    """
    own = keep(keyed(docs), "keyed")
    classes = keep(own.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    of = labelled(classes, components(links(docs, own)), "set_id")
    return looked_up(own.select("doc_id", "set_id"), "set_id", of, "component_id").select("doc_id", "component_id")
