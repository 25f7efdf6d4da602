"""Language-model scoring by a hidden Markov model.

1. encode: documents are cut into words block by block; a block is one row that holds the hashes (64 bits) of its distinct
   words in order, how often each occurs in its training documents, and every token as an index into them.
2. count: each block gives a row for each of its words; the rows are added up by word, and joined with the sums again to tell
   each block its words' totals. A word has at most one row for a block, so no word is hot, and no task holds the vocabulary.
3. emit: frequent words (CLASSES_MOST at most) are emission classes of their own, other known words share hashed classes in
   which each has its share of the count, and what was not seen in training is one class, whose mass is that of the
   words seen once (Good-Turing). So each state has a distribution over all known words and the unknown one.
4. train: Baum-Welch, incremental over shards of the documents (dealt by a hash of doc_id): expected counts of a shard are added up over
   partitions, replace its former ones, and the model moves. Every training document takes part. Cycles go on until the
   likelihood gains less than GAIN, CYCLES at most.
5. score: the scaled forward recursion gives each text's exact likelihood, many documents at a time.

A document longer than SEGMENT tokens is cut into segments that are worked on side by side: the product of a segment's transition
and emission matrices carries the forward values over it, and the backward values back, so that the recursion is exact and memory does
not grow with the document.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import keep, own_text, table

FOLDS = 10
STATES, SHARDS, CYCLES, GAIN, STAY, SEED = 6, 4, 3, 0.005, 0.9, 11
CLASSES_MOST, SHARED = 61_440, 4_095
UNKNOWN = CLASSES_MOST + SHARED
CLASSES = UNKNOWN + 1
#: Tokens of a block, of documents worked on at once, and words from which a document goes to the blocks of long ones.
BLOCK_TOKENS, AT_ONCE, LONG = 2_000_000, 300_000, 2_000
#: Tokens of a segment (what is kept of one for the way back takes some 60 MB), and words of a block that are sent on at once.
SEGMENT, SENT = 65_536, 100_000
END = b""
#: What stands for a shard where a document is not learned from.
HELD = 255
#: Pseudo-count of tokens that pull each state towards the whole corpus's distribution.
PRIOR = 500.0
BINS = 8


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def held_out() -> Column:
    """Documents that are not learned from. A null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


class _Block:
    def __init__(self) -> None:
        self.of = defaultdict(count().__next__)
        self.ids, self.held, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id: int | None, held: int, words: list[bytes]) -> None:
        """held: the document's shard, or HELD."""
        self.tokens.append(np.fromiter(map(self.of.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words)

    def row(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: -len(self.tokens[i]))
        tokens = np.concatenate([self.tokens[i] for i in order])
        lengths = np.array([len(self.tokens[i]) for i in order], np.int32)
        held = np.array([self.held[i] for i in order], np.uint8)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self.of), np.uint64, len(self.of)).view(np.int64)
        counts = np.bincount(tokens[np.repeat(held != HELD, lengths)], minlength=len(hashes))
        by_hash = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int32)
        rank[by_hash] = np.arange(len(hashes), dtype=np.int32)
        kinds = [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("distinct", pa.int64())]
        row = (uuid.uuid4().int >> 65, [self.ids[i] for i in order], pack(held), pack(lengths), pack(rank[tokens]), hashes[by_hash].tobytes(), pack(counts[by_hash].astype(np.int64)), len(hashes))
        return pa.record_batch([pa.array([v], k) for v, (_, k) in zip(row, kinds, strict=True)], names=[n for n, _ in kinds])


def encode(docs: DataFrame) -> DataFrame:
    """One row for each block of documents; long documents stand in blocks of their own, so that others need not wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [_Block(), _Block()]
        for b in batches:
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = text.as_buffer().to_pybytes().lower().split()
                words.append(END)
                held = HELD if held else xxhash.xxh64_intdigest(str(doc_id).encode(), SEED) % SHARDS
                at = int(len(words) > LONG)
                open_[at].add(doc_id, held, words)
                if open_[at].size >= BLOCK_TOKENS:
                    yield open_[at].row()
                    open_[at] = _Block()
        for block in open_:
            if block.ids:
                yield block.row()

    schema = "block long, ids array<long>, held binary, lengths binary, tokens binary, hashes binary, counts binary, distinct long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), own_text().alias("text")).mapInArrow(run, schema)


def block_words(blocks: DataFrame) -> DataFrame:
    """block, at, hash, n: a row for each distinct word of each block, with its place there and its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hashes, counts = np.frombuffer(h, np.int64), unpack(c, np.int64)
                for i in range(0, len(hashes), SENT):
                    part = hashes[i : i + SENT]
                    at = np.arange(i, i + len(part), dtype=np.int32)
                    yield pa.record_batch([pa.array(np.full(len(part), block)), pa.array(at), pa.array(part), pa.array(counts[i : i + SENT])], names=["block", "at", "hash", "n"])

    return blocks.select("block", "hashes", "counts").mapInArrow(run, "block long, at int, hash long, n long")


def count_words(words: DataFrame) -> DataFrame:
    """hash, n: how often each word of block_words() occurs in the training documents."""
    return words.groupBy("hash").agg(F.sum("n").alias("n"))


def _bin(n: str) -> Column:
    return F.floor(BINS * F.log2(n) + 1e-9)


@dataclass
class Vocabulary:
    """What the driver keeps of the counts: totals, the frequent words' hashes (sorted), and the shared classes' totals."""

    tokens: int
    types: int
    once: int
    least_bin: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    shared: np.ndarray

    def mass(self) -> np.ndarray:
        """The corpus's distribution over classes, with the unknown one."""
        out = np.zeros(CLASSES)
        out[: len(self.frequent)] = self.frequent_counts
        out[CLASSES_MOST:UNKNOWN] = self.shared
        unknown = (self.once + 1) / (self.tokens + 2)
        out *= (1 - unknown) / max(out.sum(), 1)
        out[UNKNOWN] = unknown if self.tokens else 1.0
        return out


def vocabulary(counted: DataFrame) -> Vocabulary:
    known = counted.where("n > 0").select("hash", "n", _bin("n").alias("bin"))
    found = known.groupBy("bin").agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).orderBy(F.desc("bin")).collect()
    least, room = 1 << 40, CLASSES_MOST
    for r in found:
        if r.types > room:
            break
        least, room = r.bin, room - r.types
    top = known.where(F.col("bin") >= least).select("hash", "n").collect()  # CLASSES_MOST rows at most
    hashes, counts = np.array([r.hash for r in top], np.int64), np.array([r.n for r in top], np.int64)
    order = np.argsort(hashes)
    of_class = np.zeros(SHARED, np.int64)
    for r in known.where(F.col("bin") < least).groupBy(F.pmod("hash", F.lit(SHARED)).alias("class")).agg(F.sum("n").alias("n")).collect():
        of_class[r["class"]] = r.n
    return Vocabulary(sum(r.tokens for r in found), sum(r.types for r in found), sum(r.types for r in found if r.bin == 0), least, hashes[order], counts[order], of_class)


CODED = "ids array<long>, held binary, lengths binary, codes binary, base array<double>, inner array<double>, known array<long>"


def assign(blocks: DataFrame, words: DataFrame, counted: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Blocks with their tokens as emission classes, and for each document the base score, the log10 share of its words in
    their classes, and the number of known tokens."""

    def code(block: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = np.frombuffer(block["hashes"][0].as_py(), np.int64)
        c = np.zeros(len(hashes), np.int64)
        c[answers["at"].to_numpy()] = answers["total"].to_numpy()
        low = np.mod(hashes, SHARED)
        at = np.minimum(np.searchsorted(vocab.frequent, hashes), max(len(vocab.frequent) - 1, 0))
        top = (vocab.frequent[at] == hashes) if len(vocab.frequent) else np.zeros(len(hashes), bool)
        classes = np.where(top, at, np.where(c > 0, CLASSES_MOST + low, UNKNOWN)).astype(np.uint16)
        inner = np.where(top | (c == 0), 0.0, np.log10(np.maximum(c, 1) / np.maximum(vocab.shared[low], 1)))
        base = np.log10((c + 0.1) / (vocab.tokens + 0.1 * (vocab.types + 1)))
        tokens, lengths = unpack(block["tokens"][0].as_py(), np.int32), unpack(block["lengths"][0].as_py(), np.int32)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        per_doc = lambda x: np.add.reduceat(x[tokens], starts)
        out = {"ids": block["ids"].combine_chunks(), "held": block["held"].combine_chunks(), "lengths": block["lengths"].combine_chunks(), "codes": pa.array([pack(classes[tokens])], pa.binary())}
        out |= {"base": pa.array([per_doc(base).tolist()], pa.list_(pa.float64())), "inner": pa.array([per_doc(inner).tolist()], pa.list_(pa.float64())), "known": pa.array([per_doc((c > 0).astype(np.int64)).tolist()], pa.list_(pa.int64()))}
        return pa.table(out)

    left = blocks.select("block", "ids", "held", "lengths", "tokens", "hashes").groupBy("block")
    right = words.select("block", "at", "hash").join(counted.withColumnRenamed("n", "total"), "hash").select("block", "at", "total").groupBy("block")
    return left.cogroup(right).applyInArrow(code, CODED)


@dataclass
class Model:
    """start (states), move (states x states), emit (classes x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(mass: np.ndarray, states: int = STATES) -> Model:
    """All states like the corpus, each word tilted at random towards some of them; states tend to stay."""
    tilt = np.exp(0.7 * np.random.default_rng(SEED).standard_normal((CLASSES, states)))
    tilt[UNKNOWN] = 1.0
    emit = mass[:, None] * tilt
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def portions(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents (longest first) of AT_ONCE tokens or one document."""
    i = 0
    while i < len(lengths):
        j, size = i, 0
        while j < len(lengths) and (j == i or size + lengths[j] <= AT_ONCE):
            size, j = size + int(lengths[j]), j + 1
        yield i, j
        i = j


def _active(lengths: np.ndarray) -> list[int]:
    """How many sequences (longest first) are longer than 0, 1, 2, ... tokens."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()


def _run(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, enter: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood, scaled forward values at the end) of sequences, longest first, whose states at their first token
    have the distribution `enter`. trace gets (scaled forward values, emissions, scales, classes) of each step."""
    total, last, alpha = np.zeros(len(lengths)), np.empty((len(lengths), len(model.start))), enter
    for t, n in enumerate(_active(lengths)):
        seen = codes[starts[:n] + t]
        b = model.emit[seen]
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.move) * b
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        last[:n] = alpha
        total[:n] += np.log(scale)
        if trace is not None:
            trace.append((alpha, b, scale, seen))
    return total, last


def _carry(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences x states x states, log scales): what takes the forward values before a sequence to those at its end."""
    states = len(model.start)
    out, scales = np.tile(np.eye(states), (len(lengths), 1, 1)), np.zeros(len(lengths))
    for t, n in enumerate(_active(lengths)):
        m = (out[:n].reshape(-1, states) @ model.move).reshape(n, states, states) * model.emit[codes[starts[:n] + t]][:, None, :]
        size = m.sum(axis=(1, 2))
        out[:n] = m / size[:, None, None]
        scales[:n] += np.log(size)
    return out, scales


@dataclass
class Segments:
    """The segments of some documents, longest first. before: forward values at the end of the segment before (of the first
    one: none); after: backward values at a segment's end, such that forward times backward values add up to 1."""

    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    before: np.ndarray
    after: np.ndarray
    total: np.ndarray

    def enter(self, model: Model, chosen: slice) -> np.ndarray:
        return np.where(self.first[chosen, None], model.start, self.before[chosen] @ model.move)


def segments(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Segments:
    """total: the documents' log likelihoods, if any of them has more than one segment."""
    states, counts = len(model.start), -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), counts)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
    size = np.minimum(SEGMENT, lengths[doc] - offset)
    order = np.argsort(-size, kind="stable")
    before, after, total = np.zeros((len(doc), states)), np.ones((len(doc), states)), np.zeros(len(lengths))
    if len(doc) > len(lengths):
        where = np.empty(len(doc), np.int64)
        where[order] = np.arange(len(doc))
        own, size_ = starts[doc[order]] + offset[order], size[order]
        carried, scales = (np.concatenate(x) for x in zip(*[_carry(model, codes, own[i:j], size_[i:j]) for i, j in portions(size_)], strict=True))
        ends = np.cumsum(counts)
        for d in np.flatnonzero(counts > 1).tolist():
            at = range(int(ends[d] - counts[d]), int(ends[d]))
            logs, alphas = _run(model, codes, starts[d : d + 1], size[at[0] : at[0] + 1], model.start[None, :])
            alpha, total[d] = alphas[0], logs[0]
            forwards = [alpha]
            for i in at[1:]:
                before[i] = alpha
                alpha = alpha @ carried[where[i]]
                total[d] += np.log(alpha.sum()) + scales[where[i]]
                alpha = alpha / alpha.sum()
                forwards.append(alpha)
            beta = np.ones(states)
            for i in reversed(at[1:]):
                beta = carried[where[i]] @ beta
                beta = beta / (forwards[i - 1 - at[0]] @ beta)
                after[i - 1] = beta
    return Segments(starts[doc[order]] + offset[order], size[order], offset[order] == 0, before[order], after[order], total)


def forward(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each document; documents stand longest first."""
    long = int(np.searchsorted(-lengths, -SEGMENT, side="left"))
    out = np.empty(len(lengths))
    if long:
        out[:long] = segments(model, codes, starts[:long], lengths[:long]).total
    if long < len(lengths):
        out[long:] = _run(model, codes, starts[long:], lengths[long:], np.broadcast_to(model.start, (len(lengths) - long, len(model.start))))[0]
    return out


def expect(model: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Adds the expected counts of starts, moves and emissions to `into`; returns the log likelihood."""
    cut = segments(model, codes, starts, lengths)
    return sum(_expect(model, codes, cut, slice(i, j), into) for i, j in portions(cut.lengths))


def _expect(model: Model, codes: np.ndarray, cut: Segments, chosen: slice, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    trace: list = []
    total, _ = _run(model, codes, cut.starts[chosen], cut.lengths[chosen], cut.enter(model, chosen), trace)
    states, first, before, after = len(model.start), cut.first[chosen], cut.before[chosen], cut.after[chosen]
    gammas: list = [None] * len(trace)
    beta = np.empty((0, states))
    moves = np.zeros((states, states))
    for t in range(len(trace) - 1, -1, -1):
        alpha, b, scale, _ = trace[t]
        if len(alpha) > len(beta):  # the sequences that end here
            beta = np.concatenate((beta, after[len(beta) : len(alpha)]))
        gammas[t] = alpha * beta
        weighed = b * beta / scale[:, None]
        if t:
            moves += trace[t - 1][0][: len(alpha)].T @ weighed
            beta = weighed @ model.move.T
        else:
            moves += before[~first].T @ weighed[~first]
    into[0][:] += gammas[0][first].sum(axis=0)
    into[1][:] += model.move * moves
    gamma, seen = np.concatenate(gammas), np.concatenate([x[3] for x in trace])
    for k in range(states):
        into[2][:, k] += np.bincount(seen, weights=gamma[:, k], minlength=CLASSES)
    return float(total.sum())


def expected_counts(coded: DataFrame, model: Model, shard: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the training documents of one shard, added up over partitions: emissions in slices of classes, so that no task
    adds up all of them."""
    states, parts = len(model.start), 16
    per = CLASSES // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = (np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)))
        total = 0.0
        for b in batches:
            for held, lens, coded_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lengths, codes = unpack(lens, np.int32).astype(np.int64), unpack(coded_, np.uint16)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                own = unpack(held, np.uint8)
                chosen = np.flatnonzero((own != HELD) & (own % shards == shard))
                for i, j in portions(lengths[chosen]):
                    total += expect(model, codes, starts[chosen[i:j]], lengths[chosen[i:j]], into)
        rest = np.concatenate((into[0], into[1].ravel(), [total]))
        slices = [*(into[2][i * per : (i + 1) * per] for i in range(parts)), rest]
        yield pa.record_batch([pa.array(range(parts + 1), pa.int64()), pa.array([pack(x.astype(np.float64)) for x in slices], pa.binary())], names=["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(unpack(x, np.float64) for x in rows["counts"].to_pylist())
        return pa.table({"part": rows["part"][:1].combine_chunks(), "counts": pa.array([pack(total)], pa.binary())})

    got = {r.part: unpack(bytes(r.counts), np.float64) for r in coded.select("held", "lengths", "codes").mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()}
    if not got:
        return np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)), 0.0
    rest = got.pop(parts)
    return rest[:states], rest[states:-1].reshape(states, states), np.concatenate([got[i] for i in range(parts)]).reshape(CLASSES, states), float(rest[-1])


def train(coded: DataFrame, mass: np.ndarray, states: int = STATES, shards: int = SHARDS, cycles: int = CYCLES, gain: float = GAIN) -> Model:
    """Until a cycle over all shards gains less than `gain` of the log likelihood, or for so many cycles."""
    model, kept, before = first_model(mass, states), {}, None
    for step in range(shards * cycles):
        kept[step % shards] = expected_counts(coded, model, step % shards, shards)
        start, move, emit = (sum(x[i] for x in kept.values()) for i in range(3))
        start = start + 1.0
        move = move + 1.0 + np.eye(states)
        emit = emit * (1 - mass[UNKNOWN]) + PRIOR * mass[:, None]
        emit[UNKNOWN] = 0.0
        emit = emit / np.maximum(emit.sum(axis=0), 1e-300) * (1 - mass[UNKNOWN])
        emit[UNKNOWN] = mass[UNKNOWN]
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
        if step % shards == shards - 1:
            total = sum(x[3] for x in kept.values())  # each shard's before its step
            if before is not None and total - before <= gain * abs(before):
                break
            before = total
    return model


def score(coded: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    names = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, held, lens, packed, base, inner, known in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                lengths, codes = unpack(lens, np.int32).astype(np.int64), unpack(packed, np.uint16)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                logs = np.concatenate([forward(model, codes, starts[i:j], lengths[i:j]) for i, j in portions(lengths)])
                cols = (ids, unpack(held, np.uint8) == HELD, lengths, known, [vocab.tokens] * len(ids), base, np.array(inner) + logs / np.log(10))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, names.values(), strict=True)], names=list(names))

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Null and empty texts are the end token alone. Repeated rows count as often as they occur. With no training document
    every token is unknown and has probability 1. Other columns are left out. An empty table gives none.
    """
    blocks = keep(encode(docs), "blocks", codec="uncompressed")
    words = block_words(blocks)
    counted = keep(count_words(words), "counted")
    vocab = vocabulary(counted)
    coded = keep(assign(blocks, words, counted, vocab), "coded", codec="uncompressed")
    return score(coded, train(coded, vocab.mass()), vocab)


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
