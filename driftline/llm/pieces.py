"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

The pieces of a public model are the vocabulary (nothing is trained). A segmentation's probability is proportional to the
product of its pieces' weights, a Zipf law over their ranks, raised to `sharpness`. No piece holds a line end or a space
after another character, so the lattice falls apart into units (spaces with the word after them, or a line end). The
distinct units of some thousand texts are filtered forward together; then each occurrence is sampled backward, one piece at
a step, with random numbers made from the row's key, the unit's place and the step. The same row always gives the same
pieces, wherever it is computed. Characters without a piece (and the piece sign itself) become bytes, so decoding gives
every text back.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import own_text, table
from driftline.llm.steps import Steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS, SEED, ZIPF = 0.5, 3, 10.0
#: Characters of the texts that are sampled together.
AT_ONCE = 2_000_000
#: Characters of their distinct units that are filtered together.
FILTERED_AT_ONCE = 200_000
SIGN = "▁"
_UNIT = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces of a SentencePiece model, with spaces for the sign. Small enough to go with the task: some 32,000 pieces."""

    def __init__(self, model_file: str = MODEL, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.bytes_ids = np.zeros(256, np.int64)
        self.pieces: dict[str, int] = {}
        self.out: list[bytes] = [b""] * self.size
        weights = np.zeros(self.size)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_ids[value], self.out[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain = piece.replace(SIGN, " ")
                if "\n" not in plain and " " not in plain.lstrip(" "):
                    self.pieces[plain] = i
                    self.out[i] = plain.encode()
                    weights[i] = 1.0
        ranks = np.cumsum(weights)  # the model lists its pieces by rank
        self.weights = np.where(weights > 0, (ranks + ZIPF) ** -sharpness, 0.0)
        self.byte_weight = float((ranks[-1] + ZIPF) ** -sharpness)
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def trie(self) -> tuple[Steps, np.ndarray, np.ndarray]:
        """The trie of the pieces, the piece that ends at each of its states or -1, and which characters are pieces. Built once
        in each task."""
        if self._ready is None:
            states: dict[tuple[int, str], int] = {}
            ends = {}
            for piece, i in self.pieces.items():
                state = 0
                for c in piece:
                    state = states.setdefault((state, c), len(states) + 1)
                ends[state] = i
            sources = np.fromiter((s for s, _ in states), np.int64, len(states))
            chars = np.fromiter((ord(c) for _, c in states), np.int64, len(states))
            piece_at = np.full(len(states) + 1, -1, np.int32)
            piece_at[list(ends)] = list(ends.values())
            single = np.zeros(0x110000, bool)
            single[[ord(p) for p in self.pieces if len(p) == 1]] = True
            self._ready = (Steps(len(states) + 1, sources, chars, np.arange(1, len(states) + 1)), piece_at, single)
        return self._ready


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def filtered_edges(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, ...]:
    """(end, start, code, share) of every edge in the units' lattices, by end, where unit u's first node comes after all nodes
    of the units before it. share: this edge's and the earlier ones' part of the weight that comes into their end."""
    steps, piece_at, single = vocab.trie()
    text = "\n".join(units)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    last = first + sizes
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # All places walk the trie together; no piece holds the line end that joins the units.
    classes = np.append(steps.classes[chars], np.int32(0))
    at, state, length = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.int32), 0
    found = []
    while len(at):
        to = steps(state, classes[at + length])
        at, state, length = at[to >= 0], to[to >= 0].astype(np.int32), length + 1
        piece = piece_at[state]
        found.append((length, at[piece >= 0], piece[piece >= 0]))
    inner = np.ones(len(chars), bool)
    inner[last[:-1]] = False
    odd = np.flatnonzero(inner & ~single[chars]).astype(np.int32)
    found = [*reversed(found), (1, odd, (vocab.size + chars[odd]).astype(np.int32))]
    end = np.concatenate([x + n for n, x, _ in found])
    order = np.argsort(end, kind="stable")  # of those with one end the longest first, bytes last
    start, code = (np.concatenate([x[k] for x in found])[order] for k in (1, 2))
    end = end[order]
    weight = np.append(vocab.weights, 0.0)[np.minimum(code, vocab.size)]
    spelled = np.flatnonzero(code >= vocab.size)
    c = code[spelled] - vocab.size
    weight[spelled] = vocab.byte_weight ** (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))

    # Edges stand in order of their end; level by level, those of each depth are taken in that order.
    depth = end - np.repeat(first, sizes + 1)[start]
    deepest = int(depth.max(initial=0))
    order = np.argsort(depth.astype(np.int16) if deepest < 32_000 else depth, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=deepest + 1))))[1:]
    filtered = np.zeros(int(last[-1]) + 1)  # log of the forward value of each node
    share = np.empty(len(end))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = order[a:b]
        e, before = end[i], filtered[start[i]]
        nodes = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
        per = np.diff(np.concatenate((nodes, [b - a])))
        top = np.maximum.reduceat(before, nodes)
        part = weight[i] * np.exp(before - np.repeat(top, per))
        total = np.add.reduceat(part, nodes)
        filtered[e[nodes]] = top + np.log(total)
        run = np.cumsum(part)
        run -= np.repeat(np.concatenate(([0.0], run[nodes[1:] - 1])), per)
        share[i] = run / np.repeat(total, per)
    return end, start, code, share


class Lattice:
    """Forward-filtered lattices of distinct units. Node first[u] + j stands before the j-th character of unit u. An edge
    comes into a node; `key` is the node plus the share of its weight up to and with this edge, so that one sorted search
    samples an edge. Codes from vocab.size on are characters spelled in bytes."""

    def __init__(self, vocab: Vocabulary, units: list[str]) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.last = self.first + sizes
        # some units after the others: what filtering needs beside its results does not grow with their number
        cuts = np.unique(np.searchsorted(self.first, np.arange(0, int(self.first[-1]) + 1, FILTERED_AT_ONCE)))
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(units)], strict=True):
            end, start, code, share = filtered_edges(vocab, units[a:b])
            key = end + self.first[a] + np.minimum(share, 1.0) * (1 - 1e-9)
            for held, x in zip(parts, ((end + self.first[a]).astype(np.int32), (start + self.first[a]).astype(np.int32), code, key), strict=True):
                held.append(x)
        self.key, self.code, self.start, self.end = (np.concatenate(parts.pop()) for _ in range(4))

    def sample(self, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all occurrences in order, codes of each). seeds: uint64 for each occurrence."""
        order = np.argsort(units, kind="stable")  # neighbours in the search are neighbours in memory
        node, base, seed = self.last[units][order], self.first[units][order], seeds[order]
        live = np.flatnonzero(node > base)
        which, codes, step = [], [], 0
        while len(live):
            u = (mixed(seed[live] + np.uint64((step * 0x9E3779B97F4A7C15) % (1 << 64))) >> np.uint64(11)) * 2.0**-53
            edge = np.searchsorted(self.key, node[live] + u * (1 - 2e-9), side="right")
            edge = np.minimum(edge, len(self.key) - 1)
            edge -= self.end[edge] > node[live]  # u beyond the last share, by rounding
            which.append(live)
            codes.append(self.code[edge])
            node[live] = self.start[edge]
            live = live[node[live] > base[live]]
            step += 1
        per = np.zeros(len(units), np.int64)
        for w in which:
            per[w] += 1
        counts = np.empty_like(per)
        counts[order] = per
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out = np.empty(int(counts.sum()), np.int64)
        for step, (w, c) in enumerate(zip(which, codes, strict=True)):
            at = order[w]
            out[begin[at] + counts[at] - 1 - step] = c
        return out, counts


def spell(vocab: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Piece ids, with spelled characters as the ids of their bytes."""
    odd = np.flatnonzero(codes >= vocab.size)
    if not len(odd):
        return codes
    out, before = [], 0
    for i in odd.tolist():
        data = chr(int(codes[i]) - vocab.size).encode("utf-8", "surrogatepass")
        out += [codes[before:i], vocab.bytes_ids[np.frombuffer(data, np.uint8)]]
        before = i + 1
    return np.concatenate((*out, codes[before:]))


def encode_texts(vocab: Vocabulary, keys: list[int | None], texts: list[str], seed: int = SEED) -> list[np.ndarray]:
    """Piece ids of each text; none for an empty one. A sign of space stands before every other text, as the model has it."""
    of = defaultdict(count().__next__)
    rows, row_seeds = [], []
    for key, text in zip(keys, texts, strict=True):
        rows.append(np.fromiter(map(of.__getitem__, _UNIT.findall(" " + text) if text else ()), np.int64))
        row_seeds.append(xxhash.xxh64_intdigest(f"{seed}:{key}"))
    sizes = np.array([len(r) for r in rows], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in rows]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    seeds = mixed(np.repeat(np.array(row_seeds, np.uint64), sizes) ^ mixed(place.astype(np.uint64) + np.uint64(1)))
    codes, counts = Lattice(vocab, list(of)).sample(np.concatenate(rows), seeds)
    per_row = np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=counts, minlength=len(rows)).astype(np.int64)
    return [spell(vocab, x) for x in np.split(codes, np.cumsum(per_row)[:-1])]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids: bytes are bytes, a sign is a space, and the space before the text goes."""
    return b"".join(map(vocab.out.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of a batch (key, text) in portions of AT_ONCE characters at most, or of one text."""
    sizes = pc.utf8_length(batch.column(1)).to_pylist()
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= AT_ONCE):
            size, j = size + sizes[j], j + 1
        yield batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
        i = j


def encode(docs: DataFrame, model_file: str = MODEL, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs (doc_id, text).

    Null and empty texts have no pieces. Rows with equal doc_id and text get equal pieces; a null doc_id is a key like any
    other. Other columns are left out. An empty table gives none.
    """
    vocab = Vocabulary(model_file, sharpness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, texts in _portions(b):
                rows = encode_texts(vocab, keys, texts, seed)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))
                yield pa.record_batch([pa.array(keys, pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, text for every row of encoded (doc_id, ids); null ids give an empty text."""
    vocab = Vocabulary(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(vocab, np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str = MODEL, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (of the ids as little-endian ints), lossless for every row of docs."""
    vocab = Vocabulary(model_file, sharpness)
    names = {"doc_id": pa.int64(), "n_chars": pa.int64(), "n_pieces": pa.int64(), "ids_sha256": pa.string(), "lossless": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, texts in _portions(b):
                rows = encode_texts(vocab, keys, texts, seed)
                same = [decode_ids(vocab, r) == t for r, t in zip(rows, texts, strict=True)]
                digests = [hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows]
                cols = (keys, [len(t) for t in texts], [len(r) for r in rows], digests, same)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, names.values(), strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, lossless boolean")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
