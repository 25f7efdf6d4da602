"""Numbers that are too long or too large make an error row, not a failed job."""

import pytest

from driftline.llm import matroska as m


def file(time: bytes, scale: int) -> bytes:
    head = m.element(m.EBML, b"") + b"\x18\x53\x80\x67\xff" + m.element(m.INFO, m.number(m.SCALE, scale)) + m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 1)))
    return head + m.element(m.CLUSTER, m.element(m.TIME, time) + m.element(m.SIMPLE, b"\x81\x00\x05\x80" + m.lace([b"abc"], 0)))


GOOD = file(b"\x00\x64", 1_000_000)
BAD = {"9 bytes": file(b"\x01" * 9, 1_000_000), "63 bits": file(b"\xff" * 8, 1), "beyond": file(b"\x00\x64", (1 << 64) - 1)}


def test_times_out_of_range(spark):
    assert [p[1] for p in m.parse(GOOD).packets] == [105]
    for what, data in BAD.items():
        with pytest.raises(ValueError, match=what):
            m.parse(data)
    files = [(0, bytearray(GOOD)), (9, None), *[(i, bytearray(d)) for i, d in enumerate(BAD.values(), 1)]]
    rows = m.packet_table(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert {(r.doc_id, r.timestamp_ms, r.error is not None) for r in rows} == {(0, 105, False), (1, None, True), (2, None, True), (3, None, True)}
    out = m.read_media(spark.createDataFrame([(i, 3, d) for i, d in files], "doc_id long, n_bytes long, media binary")).collect()
    assert {r.doc_id for r in out if r.error} == {1, 2, 3} and len(out) == 5
