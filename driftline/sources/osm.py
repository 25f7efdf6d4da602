"""OpenStreetMap extracts (.osm.pbf) as a Spark data source: one partition for each run of blobs, so that a file of any size is read by
many tasks; and a writer, one file for each partition.

    spark.dataSource.register(OsmSource)
    spark.read.format("osm_pbf").load(path)    # a file, or a folder of files, on any store that pyarrow.fs opens

kind is header, node, way, relation or changeset. A header's refs are its box in nanodegrees (left, right, top, bottom).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, blob long, kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"
ARROW = pa.schema([("file", pa.string()), ("blob", pa.int64()), ("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])

#: Fixed bounds of the format.
HEADER_MOST, BLOB_MOST = 64 * 1024, 32 * 1024 * 1024
#: A task reads neighbouring blobs of so many bytes together; a block that is written holds so many entities.
TASK_BYTES, BLOCK_ENTITIES = 8 * 1024 * 1024, 8_000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# numbers and messages


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def numbers(data: bytes) -> np.ndarray:
    """The varints of a packed field, all at once."""
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x < 128)
    if len(x) and (not len(ends) or ends[-1] != len(x) - 1):
        raise ValueError("a packed field is cut off")
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    if len(ends) and int((ends - starts).max()) > 9:
        raise ValueError("a number of more than ten bytes")
    place = np.arange(len(x)) - np.repeat(starts, ends - starts + 1) if len(ends) else np.zeros(0, np.int64)
    parts = (x & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts) if len(ends) else parts


def signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def along(values: np.ndarray) -> np.ndarray:
    """Differences, zigzag, made whole."""
    return np.cumsum(signed(values))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; groups are unknown to this format."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        n = shift = 0
        while at < end and shift < 70:
            b = data[at]
            at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
            if b < 128:
                return n
        raise ValueError("a number is cut off")

    while at < end:
        key = number()
        width = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        if key & 7 == 2:
            width = number()
        if width is None:
            raise ValueError(f"wire type {key & 7}")
        if at + width > end:
            raise ValueError("a field is cut off")
        yield key >> 3, data[at : at + width]
        at += width


def message(*parts: tuple[int, int | bytes]) -> bytes:
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in parts)


def packed(values: Iterator[int]) -> bytes:
    return b"".join(map(varint, values))


def steps(values: list[int]) -> bytes:
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


# blobs


def blob(kind: str, raw: bytes) -> bytes:
    body = message((2, len(raw)), (3, zlib.compress(raw)))
    head = message((1, kind.encode()), (3, len(body)))
    return struct.pack(">I", len(head)) + head + body


def blobs_of(f: pa.NativeFile) -> Iterator[tuple[int, int, str]]:
    """(start, size, type) of each blob of an open file; only headers are read."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        first = f.read(4)
        length = struct.unpack(">I", first)[0] if len(first) == 4 else -1
        if not 0 < length <= HEADER_MOST:
            raise ValueError(f"no blob header at byte {at}")
        head = f.read(length)
        found = dict(fields(head)) if len(head) == length else {}
        if 1 not in found or 3 not in found:
            raise ValueError(f"no blob header at byte {at}")
        start, n = at + 4 + length, found[3]
        if n > BLOB_MOST or start + n > size:
            raise ValueError(f"the blob at byte {start} is cut off or too large")
        yield start, n, bytes(found[1]).decode()
        at = start + n


def unpacked(body: bytes) -> bytes:
    found = dict(fields(body))
    if 1 in found:
        return found[1]
    if 3 not in found:
        raise ValueError("a compression that is not supported")
    raw = zlib.decompress(found[3])
    if len(raw) != found.get(2, len(raw)):
        raise ValueError("a blob is not as long as it says")
    return raw


def entities(kind: str, raw: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, tags) of a blob's content."""
    if kind == "OSMHeader":
        box = next((dict(fields(v)) for k, v in fields(raw) if k == 1), None)
        yield "header", None, None, None, box and [int(signed(np.array([box.get(i, 0)], np.uint64))[0]) for i in (1, 2, 3, 4)], None
        return
    if kind != "OSMData":
        return
    top = list(fields(raw))
    texts = [bytes(v).decode() for k, table in top if k == 1 for j, v in fields(table) if j == 1]
    rest = {k: v for k, v in top if isinstance(v, int)}
    shift = lambda k: int(signed_long(rest.get(k, 0)))
    degrees = lambda v, k: (shift(k) + rest.get(17, 100) * v) / 1e9
    for group in (v for k, v in top if k == 2):
        for k, v in fields(group):
            if k == 5:
                yield "changeset", next((x for j, x in fields(v) if j == 1), None), None, None, None, None
                continue
            f = dict(fields(v))
            if k == 2:
                ids, lat, lon = (along(numbers(f.get(j, b""))) for j in (1, 8, 9))
                tags = dense_tags(numbers(f.get(10, b"")).tolist(), texts, len(ids))
                yield from (("node", int(i), degrees(int(a), 19), degrees(int(o), 20), None, t) for i, a, o, t in zip(ids, lat, lon, tags, strict=True))
                continue
            tags = {texts[a]: texts[b] for a, b in zip(numbers(f.get(2, b"")).tolist(), numbers(f.get(3, b"")).tolist(), strict=True)}
            if k == 1:
                one = lambda j: int(signed(np.array([f.get(j, 0)], np.uint64))[0])  # noqa: E731, B023
                yield "node", one(1), degrees(one(8), 19), degrees(one(9), 20), None, tags
            elif k in (3, 4):
                yield "way" if k == 3 else "relation", signed_long(f.get(1, 0)), None, None, along(numbers(f.get(8 if k == 3 else 9, b""))).tolist(), tags


def signed_long(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def dense_tags(flat: list[int], texts: list[str], n: int) -> Iterator[dict]:
    """Keys and values of dense nodes, each node's ended by a 0; none at all if no node has any."""
    if not flat:
        yield from ({} for _ in range(n))
        return
    at = 0
    for _ in range(n):
        own = {}
        while flat[at]:
            own[texts[flat[at]]] = texts[flat[at + 1]]
            at += 2
        at += 1
        yield own


# the data source


@dataclass
class Blobs(InputPartition):
    file: str
    parts: list[tuple[int, int, str]]


class OsmReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Blobs]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        files = [info.path] if info.is_file else sorted(x.path for x in store.get_file_info(pafs.FileSelector(at, recursive=True)) if x.path.endswith(".pbf"))
        out = []
        for name in files:
            held: list[tuple[int, int, str]] = []
            with store.open_input_file(name) as f:
                for part in blobs_of(f):
                    if held and sum(n for _, n, _ in held) + part[1] > TASK_BYTES:
                        out.append(Blobs(name, held))
                        held = []
                    held.append(part)
            if held:
                out.append(Blobs(name, held))
        return out or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            for start, size, kind in partition.parts:
                f.seek(start)
                body = f.read(size)
                if len(body) != size:
                    raise ValueError(f"the blob at byte {start} is cut off")
                rows = [(partition.file.rsplit("/", 1)[-1], start, k, i, a, o, refs, list(tags.items()) if tags is not None else None) for k, i, a, o, refs, tags in entities(kind, unpacked(body))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class OsmSource(DataSource):
    """format("osm_pbf"): see the module."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> OsmReader:
        return OsmReader(self.options["path"])


# the writer


def block(rows: list[dict]) -> bytes:
    """A primitive block of nodes (id, lat, lon, tags) and ways (id, refs, tags)."""
    texts: dict[str, int] = {"": 0}
    text = lambda s: texts.setdefault(s, len(texts))
    nodes, ways = ([r for r in rows if r["kind"] == k] for k in ("node", "way"))
    pairs = lambda r: [(text(k), text(v)) for k, v in sorted(dict(r["tags"] or {}).items())]
    parts = []
    if nodes:
        flat = [x for r in nodes for x in (*[i for p in pairs(r) for i in p], 0)]
        whole = [[round(r[c] * 1e7) for r in nodes] for c in ("lat", "lon")]
        parts.append(message((2, message((1, steps([r["id"] for r in nodes])), (8, steps(whole[0])), (9, steps(whole[1])), *([(10, packed(flat))] if any(flat) else [])))))
    if ways:
        made = [(r["id"] % (1 << 64), pairs(r), list(r["refs"] or ())) for r in ways]
        parts.append(message(*[(3, message((1, i), (2, packed(k for k, _ in p)), (3, packed(v for _, v in p)), (8, steps(refs)))) for i, p, refs in made]))
    table = message(*[(1, t.encode()) for t in texts])
    return message((1, table), *[(2, p) for p in parts])


def write(rows: DataFrame, path: str) -> DataFrame:
    """Writes nodes and ways (kind, id, lat, lon, refs, tags) to a new folder, a file for each partition, and returns (file, entities, blobs).
    A file appears under its name when it is whole: a task that is run again replaces it by an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, at = opened(path)
        store.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.osm.pbf"
        hidden, total, blobs, held = f"{at}/_{name}-{uuid.uuid4().hex}", 0, 0, []
        with store.open_output_stream(hidden) as f:
            f.write(blob("OSMHeader", message((4, b"OsmSchema-V0.6"), (4, b"DenseNodes"))))

            def flush(least: int) -> None:
                nonlocal blobs, held
                while len(held) >= max(1, least):
                    f.write(blob("OSMData", block(held[:BLOCK_ENTITIES])))
                    held, blobs = held[BLOCK_ENTITIES:], blobs + 1

            for batch in batches:
                held += batch.to_pylist()
                total += batch.num_rows
                flush(BLOCK_ENTITIES)
            flush(1)
        if total:
            store.move(hidden, f"{at}/{name}")
            yield pa.record_batch([pa.array([name]), pa.array([total], pa.int64()), pa.array([blobs], pa.int64())], names=["file", "entities", "blobs"])
        else:
            store.delete_file(hidden)

    done = rows.select("kind", "id", "lat", "lon", "refs", "tags").mapInArrow(run, "file string, entities long, blobs long")
    spark = rows.sparkSession
    return spark.createDataFrame(done.collect(), done.schema)  # one row for each file
