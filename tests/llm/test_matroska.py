"""Timing of laced frames, broken files, tables of files from elsewhere."""

import random
import struct

import pytest

from driftline.llm import matroska as m


def file(track: bytes, *blocks: bytes, scale: int = 1_000_000) -> bytes:
    head = m.element(m.EBML, b"") + b"\x18\x53\x80\x67\xff"
    return head + m.element(m.INFO, m.number(m.SCALE, scale)) + m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 1) + track)) + m.element(m.CLUSTER, m.number(m.TIME, 100) + b"".join(blocks))


def block(frames, kind, time=5, ident=m.SIMPLE):
    return m.element(ident, b"\x81" + struct.pack(">h", time) + bytes([0x80 | kind << 1]) + m.lace(frames, kind))


def times(data):
    return [p[1] for p in m.parse(data).packets]


def test_frames_of_a_lace_follow_by_the_durations_of_the_file():
    three, uneven = [b"a" * 10] * 3, [b"a" * 400, b"b" * 800, b"c" * 4]
    assert times(file(m.element(m.CODEC, b"A_OPUS") + m.number(m.DEFAULT, 20_000_000), block(three, 2))) == [105, 125, 145]
    group = m.element(m.GROUP, block(three, 3, ident=m.BLOCK) + m.number(m.SPAN, 60))
    assert times(file(m.element(m.CODEC, b"A_OPUS"), group)) == [105, 125, 145]
    audio = m.element(m.AUDIO, m.element(m.RATE, struct.pack(">d", 1000.0)) + m.number(m.CHANNELS, 2) + m.number(m.DEPTH, 16))
    assert times(file(m.element(m.CODEC, b"A_PCM/INT/LIT") + audio, block(uneven, 1))) == [105, 205, 405]  # 4 bytes a sample of both channels
    assert times(file(m.element(m.CODEC, b"A_PCM/INT/LIT") + audio, block(uneven, 3), scale=100_000)) == [105, 1105, 3105]
    assert times(file(m.element(m.CODEC, b"V_VP9"), block(three, 2))) == [105, 105, 105]


def test_own_files_use_every_lacing():
    data = m.write(bytes(range(256)) * 9 * 30)
    found = m.parse(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in found.packets) == bytes(range(256)) * 9 * 30
    assert [p[1] for p in found.packets] == [72 * i for i in range(len(found.packets))]


def test_broken_files_raise_value_errors_only(spark):
    whole = file(m.element(m.CODEC, b"A_OPUS") + m.number(m.DEFAULT, 20_000_000), block([b"a" * 300, b"b" * 20, b"c"], 1), block([b"a" * 300, b"b" * 20, b"c"], 3))
    draw, broken = random.Random(1), [b"", b"\x1a\x45\xdf\xa3", whole[:50], m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE, b"\x81\x00")))]
    for _ in range(3000):
        data = bytearray(whole[: draw.randrange(len(whole))] if draw.random() < 0.5 else whole)
        for _ in range(draw.randrange(4)):
            if data:
                data[draw.randrange(min(len(data), 120))] = draw.randrange(256)
        try:
            m.parse(bytes(data))
        except ValueError:
            pass
    for data in broken:
        with pytest.raises(ValueError):
            m.parse(data)
    df = spark.createDataFrame([(1, 5, whole, "x"), (2, 5, broken[1], "x"), (3, 5, None, "x"), (None, 5, broken[3], "x")], "doc_id int, n_bytes long, media binary, start string")
    rows = m.packet_table(df).collect()
    assert sorted((r.doc_id or 0, r.error is None) for r in rows) == [(0, False), (1, True), (1, True), (1, True), (1, True), (1, True), (1, True), (2, False)]
    read = {r.doc_id: r for r in m.read_media(df).collect()}
    assert read[1].error is None and read[2].error and read[2].feature is None and read[3].media_bytes is None and read[None].error
