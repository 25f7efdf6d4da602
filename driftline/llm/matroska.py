"""Media columns: Matroska files in a binary column, written from samples and parsed into packet tables.

The parser walks EBML elements (variable-length ids and sizes, unknown sizes of segments and clusters), reads tracks,
clusters, simple blocks and block groups with all four kinds of lacing, and cues. A packet has its track, timestamp,
byte range and cluster. The frames of a lace follow one another by the track's default duration, else by the block's duration in equal
parts, else, for PCM, by the samples that they hold. Broken files raise ValueError, and give a row with the error in tables. Each file stands in one row, so files are spread over the executors as their rows are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import own_text, table

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, SPAN, REFERS = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
DEFAULT = 0x23E383
POINT, CUE_TIME, CUE_WHERE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME, HERTZ, LACED, BLOCKS = 576, 8000, 8, 48
FRAME_MS = FRAME * 1000 // HERTZ
PAD = b"\xff"


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as an EBML size; an all-ones value is kept for "unknown", so it takes a byte more."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(data)) + data


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block after its flags. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(samples: bytes) -> bytes:
    """A file with one track of 8-bit mono PCM. len(samples) is a positive multiple of FRAME; blocks lace eight frames, by
    the three kinds of lacing in turn."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    n = len(samples) // FRAME
    info = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"driftline") + element(WRITER, b"driftline") + element(DURATION, struct.pack(">d", float(n * FRAME_MS))))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(HERTZ))) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(DEFAULT, FRAME * 1_000_000_000 // HERTZ) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, n, LACED * BLOCKS):
        blocks = [number(TIME, c * FRAME_MS)]
        for b in range(c, min(n, c + LACED * BLOCKS), LACED):
            frames = [samples[i * FRAME : (i + 1) * FRAME] for i in range(b, min(n, b + LACED))]
            kind = (2, 1, 3)[b // LACED % 3] if len(frames) > 1 else 0
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">h", (b - c) * FRAME_MS) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_WHERE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ticks, start, size, cluster, keyframe); cues: (tick, track,
    byte of the cluster in the file)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """(value, next byte, unknown) of the variable-length integer at a byte; ids keep their marker."""
    first = data[at] if at < len(data) else 0
    if not first:
        raise ValueError(f"no EBML integer at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"an EBML integer is cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    rest = n & (1 << 7 * width) - 1
    return (n if marker else rest), at + width, rest == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, start, end) of each element between two bytes. An unknown size reaches to the end."""
    while at < end:
        ident, start, _ = vint(data, at, marker=True)
        n, start, unknown = vint(data, start)
        stop = end if unknown else start + n
        if stop > end:
            raise ValueError(f"the element at byte {at} goes beyond its parent")
        yield ident, at, start, stop
        at = stop


def laced(data: bytes, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block."""
    track, at, _ = vint(data, start)
    if at + 3 > end:
        raise ValueError(f"the block at byte {start} is cut off")
    time, flags = struct.unpack(">hB", data[at : at + 3])
    at, kind = at + 3, flags >> 1 & 3
    if kind == 0:
        return track, time, flags, [(at, end - at)]
    if at >= end:
        raise ValueError(f"the lacing of the block at byte {start} is cut off")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // n] * n
        if sizes[0] * n != end - at:
            raise ValueError(f"fixed lacing does not divide the block at byte {start}")
    else:
        for i in range(n - 1):
            if kind == 1:
                stop = at
                while stop < end and data[stop] == 255:
                    stop += 1
                if stop >= end:
                    raise ValueError(f"the lacing of the block at byte {start} is cut off")
                size, at = 255 * (stop - at) + data[stop], stop + 1
            else:
                before = at
                size, at, _ = vint(data, at)
                if i:
                    size += sizes[-1] - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"the lacing of the block at byte {start} exceeds it")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, time, flags, ranges


def offsets(track: dict, scale: int, sizes: list[int], span: int | None) -> list[int]:
    """Ticks from a block's time to each of its frames. span: the block's duration in ticks, if it says so."""
    n = len(sizes)
    if track.get("default"):
        return [round(k * track["default"] / scale) for k in range(n)]
    if span:
        return [span * k // n for k in range(n)]
    if track.get("codec", "").startswith("A_PCM") and track.get("hertz", 8000.0) > 0:
        width = track.get("channels", 1) * max(track.get("depth", 8) // 8, 1)
        before = np.concatenate(([0], np.cumsum(sizes[:-1]))) / max(width, 1)
        return np.rint(before * 1e9 / track.get("hertz", 8000.0) / scale).astype(np.int64).tolist()
    return [0] * n


def parse(data: bytes) -> Media:
    """Reads a whole file; raises ValueError where its structure breaks."""
    out = Media()

    def uint(a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError(f"an EBML number of {b - a} bytes at byte {a}")
        return int.from_bytes(data[a:b], "big")

    def real(a: int, b: int) -> float:
        if b - a not in (0, 4, 8):
            raise ValueError(f"no EBML float at byte {a}")
        return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0

    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")

    def cluster(first: int, start: int, end: int) -> int:
        """Returns the byte after it; a cluster of unknown size ends at the next element of the segment."""
        base, c = 0, len(out.clusters)
        out.clusters.append((first, 0))
        for ident, at, a, b in elements(data, start, end):
            if ident in (CLUSTER, CUES, TRACKS, INFO):
                return at
            inside = list(elements(data, a, b)) if ident == GROUP else []
            blocks = [(x, y) for i, _, x, y in inside if i == BLOCK] if ident == GROUP else [(a, b)] if ident == SIMPLE else []
            span = next((uint(x, y) for i, _, x, y in inside if i == SPAN), None)
            if ident == TIME:
                base = uint(a, b)
                out.clusters[c] = (first, base)
            for x, y in blocks:
                track, time, flags, ranges = laced(data, x, y)
                key = not any(i == REFERS for i, *_ in inside) if ident == GROUP else bool(flags & 0x80)
                later = offsets(out.tracks.get(track, {}), out.scale or 1, [size for _, size in ranges], span)
                out.packets += [(track, base + time + d, at, size, c, key) for d, (at, size) in zip(later, ranges, strict=True)]
        return end

    def segment(start: int, end: int) -> None:
        at = start
        while at < end:
            ident, first, a, b = next(elements(data, at, end))
            at = b
            if ident == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == SCALE:
                        out.scale = uint(x, y)
                    elif i == DURATION:
                        out.duration = real(x, y)
            elif ident == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == ENTRY:
                        found: dict = {}
                        for j, _, p, q in elements(data, x, y):
                            if j in (NUMBER, KIND, DEFAULT):
                                found[{NUMBER: "number", KIND: "kind", DEFAULT: "default"}[j]] = uint(p, q)
                            elif j == CODEC:
                                found["codec"] = data[p:q].rstrip(b"\0").decode()
                            elif j == AUDIO:
                                for k, _, r, s in elements(data, p, q):
                                    if k == RATE:
                                        found["hertz"] = real(r, s)
                                    elif k in (CHANNELS, DEPTH):
                                        found["channels" if k == CHANNELS else "depth"] = uint(r, s)
                        out.tracks[found.get("number", 0)] = found
            elif ident == CLUSTER:
                at = cluster(first, a, b)
            elif ident == CUES:
                for i, _, x, y in elements(data, a, b):
                    if i == POINT:
                        time = next((uint(p, q) for j, _, p, q in elements(data, x, y) if j == CUE_TIME), 0)
                        for j, _, p, q in elements(data, x, y):
                            if j == CUE_WHERE:
                                where = {k: uint(r, s) for k, _, r, s in elements(data, p, q) if k in (CUE_TRACK, CUE_CLUSTER)}
                                out.cues.append((time, where.get(CUE_TRACK, 0), start + where.get(CUE_CLUSTER, 0)))

    for ident, _, a, b in top:
        if ident == SEGMENT:
            segment(a, b)
    last = max((abs(t) for _, t, *_ in out.packets), default=0)
    if last * out.scale >= 1 << 63 or max((p[0] for p in out.packets), default=0) >= 1 << 63:
        raise ValueError("a track or a timestamp in nanoseconds is beyond 63 bits")
    return out


def features(samples: bytes, media: Media) -> str:
    """Whole-number features of the samples, in one string."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    mean = int(x.sum(dtype=np.int64)) * 1000 // max(n, 1)
    power = int(np.bincount(x, minlength=256).astype(object) @ (np.arange(256) ** 2).astype(object)) * 1000 // max(n, 1)
    up = x > 127
    crossings = int(np.count_nonzero(up[1:] != up[:-1])) if n else 0
    last = max((p[1] for p in media.packets), default=0)
    good = len({c[2] for c in media.cues} & {c[0] for c in media.clusters})
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={good};last_ms={last * media.scale // 1_000_000};mean={mean};power={power};crossings={crossings}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a Matroska file) for every row of docs (doc_id, text).

    The samples are the text's UTF-8 and bytes 255 up to a positive multiple of FRAME. Null counts as empty: one frame
    of padding. Repeated rows stay; other columns are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, files = [], [], []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                data = t.as_buffer().to_pybytes()
                n = max(FRAME, -(-len(data) // FRAME) * FRAME)
                ids.append(i.as_py())
                ns.append(len(data))
                files.append(write(data + PAD * (n - len(data))))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """doc_id, track, timestamp_ms, start, size, cluster, keyframe, error: a row for each packet of column media. Null
    files have none; a broken file has one row with its error and nothing else."""

    names = {"doc_id": pa.int64(), "track": pa.int64(), "timestamp_ms": pa.int64(), "start": pa.int64(), "size": pa.int64(), "cluster": pa.int64(), "keyframe": pa.bool_(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in zip(b.column(0), b.column(1), strict=True):
                if f.is_valid:
                    try:
                        m = parse(f.as_py())
                        cols = list(zip(*m.packets, strict=True)) or [()] * 6
                        values = [[i.as_py()] * len(m.packets), cols[0], [t * m.scale // 1_000_000 for t in cols[1]], *cols[2:], [None] * len(m.packets)]
                    except ValueError as e:
                        values = [[i.as_py()], *[[None]] * 6, [str(e)]]
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(values, names.values(), strict=True)], names=list(names))

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, track long, timestamp_ms long, start long, size long, cluster long, keyframe boolean, error string")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, error. A broken file has its error and the digest of its bytes only; a null file nothing."""
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, f in zip(*b.columns, strict=True):
                if not f.is_valid:
                    rows.append((i.as_py(), n.as_py(), *[None] * 7))
                    continue
                data = f.as_buffer().to_pybytes()
                stored = (len(data), hashlib.sha256(data).hexdigest())
                try:
                    m = parse(data)
                except ValueError as e:
                    rows.append((i.as_py(), n.as_py(), None, None, None, *stored, None, str(e)))
                    continue
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in m.packets])
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, features(payload, m), None))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, names.values(), strict=True)], names=list(names))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(to_media(table(spark, sf_dir, "documents"))).drop("error")
