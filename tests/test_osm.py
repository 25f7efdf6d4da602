"""Extracts written and read back over many tasks, and broken ones."""

import random
import struct

import pytest

from driftline.sources import osm

KIND = "kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"


def test_numbers():
    rng = random.Random(1)
    values = [0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1, *[rng.getrandbits(rng.randrange(1, 64)) for _ in range(500)]]
    assert osm.numbers(osm.packed(values)).tolist() == values and osm.numbers(b"").tolist() == []
    whole = [rng.randrange(-(1 << 40), 1 << 40) for _ in range(300)]
    assert osm.along(osm.numbers(osm.steps(whole))).tolist() == whole
    for bad in (b"\x80", b"\x01\xff"):
        with pytest.raises(ValueError):
            osm.numbers(bad)
    with pytest.raises(ValueError):
        list(osm.fields(b"\x0a\x05ab"))


def test_round_trip_over_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    nodes = [("node", rng.randrange(-(1 << 45), 1 << 45), round(rng.uniform(-90, 90), 7), round(rng.uniform(-180, 180), 7), None, {"name": f"é{i}"} if i % 3 == 0 else {}) for i in range(900)]
    ways = [("way", i, None, None, [rng.randrange(1 << 40) for _ in range(rng.randrange(0, 30))], {"highway": rng.choice(["a", "b"]), "k": str(i)}) for i in range(700)]
    rows = spark.createDataFrame(nodes + ways, KIND).repartition(3)
    path = str(tmp_path / "extract")
    files = osm.write(rows, path).collect()
    assert sum(f.entities for f in files) == 1600 and len(files) == 3
    spark.dataSource.register(osm.OsmSource)
    monkeypatch.setattr(osm, "TASK_BYTES", 5_000)
    parts = osm.OsmReader(path).partitions()
    assert len(parts) == 6 and sum(len(p.parts) for p in parts) == 3 + sum(f.blobs for f in files)
    back = spark.read.format("osm_pbf").load(path)
    got = sorted((r.kind, r.id, r.lat, r.lon, r.refs, tuple(sorted(r.tags.items()))) for r in back.where("kind <> 'header'").collect())
    assert got == sorted((k, i, a, o, r, tuple(sorted(t.items()))) for k, i, a, o, r, t in nodes + ways)
    assert back.where("kind = 'header'").count() == 3 and back.select("blob", "file").distinct().count() == 3 + sum(f.blobs for f in files)


def test_other_content_and_broken_files(spark, tmp_path):
    box = osm.message((1, osm.zigzag(-5)), (2, osm.zigzag(7)), (3, 2), (4, 0))
    plain = osm.message((1, osm.zigzag(12)), (8, osm.zigzag(210_000_000)), (9, osm.zigzag(1_058_000_000)))
    group = osm.message((1, plain), (4, osm.message((1, 77), (2, b""), (3, b""), (9, osm.steps([5, 3])))), (5, osm.message((1, 8))))
    raw = osm.message((1, osm.message((1, b""))), (2, group))
    stored = osm.message((1, raw))  # not compressed
    head = osm.message((1, b"OSMData"), (3, len(stored)))
    good = osm.blob("OSMHeader", osm.message((1, box))) + osm.blob("Other", b"xyz") + struct.pack(">I", len(head)) + head + stored
    spark.dataSource.register(osm.OsmSource)

    def read(data):
        path = tmp_path / f"{abs(hash(data))}.osm.pbf"
        path.write_bytes(data)
        return [(r.kind, r.id, r.lat, r.lon, r.refs) for r in spark.read.format("osm_pbf").load(str(path)).collect()]

    assert read(good) == [("header", None, None, None, [-5, 7, 1, 0]), ("node", 12, 21.0, 105.8, None), ("relation", 77, None, None, [5, 3]), ("changeset", 8, None, None, None)]
    assert read(b"") == []
    lzma = osm.message((4, b"?"))
    for bad in (good[:-3], good[:2], b"\0\0\0\0", good + b"\xff\xff\xff\xff", struct.pack(">I", 12) + osm.message((1, b"OSMData"), (3, len(lzma))) + lzma):
        with pytest.raises(Exception, match="Error|blob|compression"):
            read(bad)
