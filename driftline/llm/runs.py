"""Periodic runs of words: stretches that repeat with a period, and texts with each run cut down to its first period.

A suffix automaton of the words gives for each state the end positions of one repeated stretch. Going from long states to
short ones, the smaller of two ordered sets of end positions is added to the larger; two ends that become neighbours at a
distance of no more than the state's length mark a square of that period, which is extended both ways to its run. The last
two ends of every run's leading part are such neighbours: an end between them would give the run a smaller period.

Only stretches whose words all lie in a repeated stretch of half the least length can hold a run; automata are built over
these alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import WORD, let, own_text, table

#: A run has at least so many words and at least two periods.
LEAST = 12

#: A block of an ordered set is split when it has twice as many entries.
BLOCK = 512


class Ends:
    """An ordered set of numbers in blocks: adding to a large one moves few entries."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Takes in x, which is new; its neighbours."""
        k = max(bisect_left(self.firsts, x) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(i, x)
        self.size += 1
        if not i:
            self.firsts[k] = x
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(k + 1, block[BLOCK])
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, link and own end position (-1: none) of each state of the words' suffix automaton; state 0 is the root."""
    length, link, end, out = [0], [-1], [-1], [{}]
    last = 0
    for at, word in enumerate(words):
        new, p = len(length), last
        length.append(at + 1)
        link.append(0)
        end.append(at)
        out.append({})
        while p >= 0 and word not in out[p]:
            out[p][word] = new
            p = link[p]
        if p >= 0:
            q = out[p][word]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                out.append(out[q].copy())
                while p >= 0 and out[p].get(word) == q:
                    out[p][word] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    return length, link, end


def squares(words: list[int], least: int) -> list[tuple[int, int]]:
    """(distance, end), ascending, of squares with at least one in each run of `least` words or more: the words at `end` and
    at `distance` before it end the same stretch of that distance or more."""
    length, link, end = automaton(words)
    n, found = len(words), []
    sets: list[Ends | None] = [None] * len(length)

    def put(own: Ends, x: int, long: int) -> None:
        before, after = own.add(x)
        if before is not None and least - long <= x - before <= long:
            found.append((x - before) * n + x)
        if after is not None and least - long <= after - x <= long:
            found.append((after - x) * n + after)

    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        own, long = sets[v], length[v]
        if 2 * long < least:
            break  # neither this state nor any after it has a square that is long enough
        if end[v] >= 0:
            if own is None:
                own = Ends(end[v])
            else:
                put(own, end[v], long)
        up, sets[v] = link[v], None
        long = length[up]
        if 2 * long < least:
            continue
        other = sets[up]
        if other is None:
            sets[up] = own
            continue
        if other.size < own.size:
            own, other = other, own
        for x in own:
            put(other, x, long)
        sets[up] = other
    return [divmod(int(x), n) for x in np.unique(np.array(found, np.int64))]


def repeated_stretches(words: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches whose words all lie in stretches of `width` words that occur twice within them."""
    found, todo = [], [(0, len(words))]
    while todo:
        a, b = todo.pop()
        count = b - a - width + 1
        if count < 2:
            continue
        mixed = np.zeros(count, np.uint64)
        for k in range(width):  # equal stretches have equal numbers; unequal ones that do only make the result longer
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[a + k : a + k + count]
        _, same, often = np.unique(mixed, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(often[same] > 1)
        if not len(starts):
            continue
        cuts = np.flatnonzero(np.diff(starts) > width)
        parts = [(a + int(x), a + int(y) + width) for x, y in zip(starts[np.r_[0, cuts + 1]], starts[np.r_[cuts, len(starts) - 1]], strict=True)]
        (found if parts == [(a, b)] else todo).extend(parts)
    return sorted(found)


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a row of word numbers, by start and period."""
    best: dict[tuple[int, int], int] = {}
    for a, b in repeated_stretches(words.astype(np.uint64), max(1, (least + 1) // 2)):
        own = words[a:b].tolist()
        d, done = 0, -1
        for distance, end in squares(own, least):
            if distance != d:
                d, done = distance, -1
            if end <= done:
                continue
            low = high = end
            while low > d and own[low - 1] == own[low - 1 - d]:
                low -= 1
            while high + 1 < len(own) and own[high + 1] == own[high + 1 - d]:
                high += 1
            done, run = high, (a + low - d, high - low + 1 + d)
            if run[1] >= max(least, 2 * d) and best.get(run, d) >= d:
                best[run] = d
    return sorted((start, length, period) for (start, length), period in best.items())


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (text; a column runs or collapsed is replaced, all others are kept) with

    * runs: array of (start, length, period), word numbers from 0: every stretch of `least` words or more, and of two periods
      or more, that no neighbouring word extends; period is its smallest. By start, then period;
    * collapsed: the words, joined by one space, without those that follow the first period of a run.

    Words are cut at space and \\x09-\\x0D. Null and empty texts, and texts of white space, have no runs and an empty collapsed text;
    repeated rows stay repeated; an empty table gives an empty table. One text is worked on at a time, whole.
    """
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    kind = docs.select(*others, F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit("").alias("collapsed")).schema
    inside = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            all_runs, collapsed = [], []
            for text in texts:
                words = (text.as_py() or "").encode().split()
                found = runs_of(_numbered(words), least) if len(words) >= least else []
                if found:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in found:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    words = [w for w, d in zip(words, np.cumsum(drop), strict=False) if not d]
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(b" ".join(words).decode())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(all_runs, pa.list_(inside)), pa.array(collapsed, pa.string())], names=[*others, "runs", "collapsed"])

    return docs.select(*others).mapInArrow(run, kind)


def planted(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten with a made repetition: with h the crc32 of the id and g = h // 10, the n words from
    number a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8) words from there; all other texts as they are. Documents
    without an id are left alone."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(a, lambda a: let(p, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    return F.when((h % 10 == 0) & text.rlike(WORD), let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeated)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them with a made repetition, as digests: see periodic_runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(own_text(), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(F.col("longest.length") * 1000 / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
