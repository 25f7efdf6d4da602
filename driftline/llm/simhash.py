"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are compared in blocks whose bits are stored vertically: plane b holds bit b of every fingerprint of
the block, 64 of them to a machine word. A query's distance to all of them is counted at once by carry-save
counters (ones, twos, fours; what overflows the radius sticks), plane by plane, and a column of 64 fingerprints is
abandoned as soon as each of its distances exceeds the radius.

Which blocks meet: 64 bits are cut into r + k pieces (r the radius); two fingerprints within r bits agree on k
pieces at least, so every choice of k pieces is a bucket key. k follows the number of fingerprints, so that a
bucket holds some thousands of unrelated ones at most; every k is exact. A bucket with more than `block`
fingerprints (near copies of one text) is dealt into chunks, and each pair of chunks is a block of its own, so that no
task holds a whole bucket. Only a spanning star of each block's links leaves it.

Pairs of chunks grow with the square of a bucket. Where they would be more than FLOOD for each fingerprint, the fingerprints of the
bucket are sent to all values within half the radius instead (some 1,400 at radius 4, whatever the bucket's size): two
fingerprints are within the radius if and only if they share such a value, so those that meet are linked without a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import HOT_ROWS, keep, looked_up, own_text, partitions, table

SEED, SHINGLE, RADIUS, BLOCK = 42, 4, 4, 2048
#: Unrelated fingerprints that a bucket may hold on average before its key takes one piece more.
BUCKET = 4096
#: Chunks of a bucket from which its fingerprints are sent to their neighbours instead of into pairs of chunks.
FLOOD = 1024
#: Shingles whose bits are counted at once: 64 bytes each.
AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, found = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        j = min(n, i + AT_ONCE)
        stops = ends[i + shingle - 1 : j + shingle - 1] if len(words) >= shingle else ends[-1:]
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[i:j].tolist(), stops.tolist(), strict=True)), np.uint64, j - i)
        found += bit_counts(h)
    return majority(found, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, in how many hashes it is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(bits, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit planes of the fingerprints, 64 lanes to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    width = -(-len(fps) // 64) * 64
    full = np.zeros((64, width), np.uint8)
    full[:, : len(fps)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(queries, fps) booleans: at most `radius` (under 8) bits differ. Bit-sliced, with carry-save counters."""
    stored = planes(fps)
    ask = np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64)
    ask = np.uint64(0) - ask  # a bit becomes a whole word of it
    every = np.concatenate((fps, queries))
    differing = np.bitwise_or.reduce(every) ^ np.bitwise_and.reduce(every)  # planes that are not constant here
    todo = [b for b in range(64) if int(differing) >> b & 1]
    columns = np.arange(stored.shape[1])
    ones = np.zeros((len(queries), len(columns)), np.uint64)
    twos, fours, over = np.zeros_like(ones), np.zeros_like(ones), np.zeros_like(ones)
    for k, b in enumerate(todo):
        carry = stored[b, columns][None, :] ^ ask[b][:, None]
        more = ones & carry
        ones ^= carry
        carry = twos & more
        twos ^= more
        over |= fours & carry  # 8 and above never come back
        fours ^= carry
        if k % 6 == 5 and k + 1 < len(todo):
            alive = ~_exceeds(ones, twos, fours, over, radius)
            live = alive.any(axis=0)
            if not live.any():
                return np.zeros((len(queries), len(fps)), bool)
            if live.mean() < 0.75:
                columns, ones, twos, fours, over = columns[live], ones[:, live], twos[:, live], fours[:, live], over[:, live]
    out = np.zeros((len(queries), stored.shape[1]), np.uint64)
    out[:, columns] = ~_exceeds(ones, twos, fours, over, radius)
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (over: 8 or more) is above the radius, by bitwise comparison from the top bit."""
    above, same = over.copy(), ~over
    for counter, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same = same & counter
        else:
            above |= same & counter
            same = same & ~counter
    return above


def stars(fps: np.ndarray, radius: int = RADIUS, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of a block's links, one pair for each fingerprint that is not its component's first."""
    label = np.arange(len(fps))
    for i in range(0, len(fps), tile):
        near = within(fps[i : i + tile], fps[i:], radius)
        for q in np.flatnonzero(near.sum(axis=1) > 1):
            met = label[i + np.flatnonzero(near[q])]
            low = met.min()
            if (met != low).any():
                label[np.isin(label, met)] = low
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[member]], fps[member]


def _pieces(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bucket keys as lists of (shift, bits), for n fingerprints."""
    k = 1
    while k < 5 and n / 2 ** (64 * k // (radius + k)) > BUCKET:
        k += 1
    cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(radius + k), k)]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, flood: int = FLOOD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join the same ones as all pairs within radius."""
    spark = distinct.sparkSession
    keys, fixed = [], []
    for i, key in enumerate(_pieces(distinct.count(), radius)):
        value, at = F.lit(0).cast("long"), 0
        for shift, bits in key:
            value, at = value + F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1), at), at + bits
        keys.append(value + F.lit(i << 56).cast("long"))
        fixed.append({b for shift, bits in key for b in range(shift, shift + bits)})
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("chunks"))
    hot = keep(hot, "hot")  # distinct.count() * len(keys) / block rows at most
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
    even = dealt.where(F.col("chunks") <= flood).select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    even = even.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    found = compared(even, radius)
    if hot.where(F.col("chunks") > flood).limit(1).count():
        found = found.union(shared_neighbours(dealt.where(F.col("chunks") > flood).select("fp", "key"), radius, fixed)).distinct()
    return found


def shared_neighbours(rows: DataFrame, radius: int, fixed: list[set[int]]) -> DataFrame:
    """(a, b): stars of the fingerprints (fp) of a bucket (key) that share a value within half the radius. radius is even;
    fixed[i]: the bits on which the fingerprints of a bucket of the i-th kind agree. At most sum of C(64, radius / 2) share one value."""
    if radius % 2:
        raise ValueError("half a radius is a whole number of bits")
    masks = []
    for bits in fixed:
        free = [1 << b for b in range(64) if b not in bits]
        masks.append(np.array([sum(c) for k in range(radius // 2 + 1) for c in combinations(free, k)], np.uint64))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, kinds = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy() >> 56
            for kind in np.unique(kinds).tolist():
                own = fps[kinds == kind]
                for i in range(0, len(own), 256):
                    part = own[i : i + 256]
                    values = (part[:, None] ^ masks[kind][None, :]).ravel()
                    yield pa.record_batch([pa.array(np.repeat(part, len(masks[kind])).view(np.int64)), pa.array(np.full(len(values), kind)), pa.array(values.view(np.int64))], names=["fp", "kind", "value"])

    near = rows.mapInArrow(spread, "fp long, kind long, value long").groupBy("kind", "value").agg(F.array_sort(F.collect_set("fp")).alias("met")).where(F.size("met") > 1)
    return near.select(F.col("met")[0].alias("a"), F.explode(F.slice("met", 2, F.size("met") - 1)).alias("b"))


def compared(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning star of the links within each block (column block) of fingerprints (column fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(fps: np.ndarray) -> pa.RecordBatch:
            a, b = stars(np.unique(fps).view(np.uint64), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        open_block, waiting = None, []  # the rows come sorted by block; one block is held at a time
        for batch in batches:
            block_ids, fps = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(block_ids)) + 1
            for part, at in zip(np.split(fps, cuts), np.concatenate(([0], cuts)), strict=True):
                if not len(part):
                    continue
                if block_ids[at] != open_block:
                    if sum(map(len, waiting)) > 1:
                        yield solve(np.concatenate(waiting))
                    open_block, waiting = block_ids[at], []
                waiting.append(part)
        if sum(map(len, waiting)) > 1:
            yield solve(np.concatenate(waiting))

    return dealt.repartition(partitions(dealt.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of each node with a link: root is the smallest node of its component. Alternates large and small
    stars until every node hangs on its root; each round is written to the shared folder, and hubs are looked up by broadcast."""
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def lowest(rows: DataFrame, least: Column) -> DataFrame:
        return rows.groupBy("u").agg(least.alias("low"), F.count("*").alias("n"))

    while True:
        size, nodes = now.agg(F.count("*"), F.countDistinct("u")).first()
        if size == nodes and not now.join(now.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        settle = (lambda df: keep(df, name)) if size > HOT_ROWS else (lambda df: df)  # read twice where a hub may be hot
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(lowest(both, F.least("u", F.min("v"))))
        large = settle(joined_low(both, low, size).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        low = settle(lowest(large, F.min("v")))
        small = joined_low(large, low, size)
        now = keep(small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), name)


def joined_low(rows: DataFrame, low: DataFrame, size: int) -> DataFrame:
    return looked_up(rows, "u", low, "low") if size > HOT_ROWS else rows.join(low.drop("n"), "u")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text; other columns are left).

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows stay
    repeated. component_id is the smallest doc_id reachable over links of at most `radius` differing bits; a null
    doc_id stays null and never becomes a component_id unless its component has no other. An empty table gives none.
    """
    own = keep(fingerprints(docs, shingle), "fingerprints")
    classes = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    of = labelled(classes, components(links(classes.select("fp"), radius)), "fp")
    return looked_up(own, "fp", of, "component_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key, n, component_id of each class (key, first, n): the smallest `first` of the classes with its root."""
    joined = classes.join(roots, classes[key] == roots.node, "left").select(key, "first", "n", F.coalesce("root", key).alias("root"))
    joined = keep(joined, "rooted")
    first = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return keep(looked_up(joined.withColumnRenamed("n", "rows"), "root", first, "component_id").select(key, F.col("rows").alias("n"), "component_id"), "labelled")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
