"""Archives of large records, records of every shape, hot digests."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import warc


def pieces(data: bytes):
    found = warc.Records()
    out = [r for piece in data.split(warc.END.encode()) for r in found.add(piece)]
    found.close()
    return out


def test_records_are_put_together_from_pieces():
    head = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\nX: y: z" % n
    end = warc.END.encode()
    for content in (b"", b"x", end, end * 3, b"a" + end, end + b"\r\n", b"\r\n\r", b"WARC/1.1" + end + b"Content-Length: 3"):
        data = (head(len(content)) + end + content + end) * 2
        got = pieces(data)
        assert [c for _, c in got] == [content] * 2 and got[0][0]["x"] == "y: z"
    with pytest.raises(ValueError):
        pieces(head(2) + end + b"abc" + end)
    with pytest.raises(ValueError):
        pieces(b"something else" + end)
    with pytest.raises(ValueError):
        pieces(head(9) + end + b"abc")


def test_archives_of_large_and_odd_payloads(spark, tmp_path):
    large = "é\r\n\r\n" * 700_000
    payloads = ["", "\r\n\r\n", "\r\n\r\n\r\n", "\r", "x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", large, large + "!", "same", "same"]
    df = spark.createDataFrame([(i, f"http://x/{i}", p) for i, p in enumerate(payloads)], "page_id long, url string, html string")
    warc.write_archives(df.coalesce(2), str(tmp_path / "a"))
    got = {r.page_id: r for r in warc.resolved_archives(spark, str(tmp_path / "a")).collect()}
    for i, p in enumerate(payloads):
        data = p.encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].intact) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True)
    assert (got[7].record_type, got[7].refers_to, got[8].record_type) == ("revisit", 8, "response")
    whole = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "a" / "part-*"))))
    assert whole.count(b"WARC-Type: response") == 8 and whole.endswith(b"\r\n\r\n")


def test_hot_keys_are_looked_up_like_others(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 60 else f"k{i % 7}" if i < 90 else None) for i in range(100)], "page_id long, k string")
    found = rows.where("k is not null and k <> 'k3'").groupBy("k").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    plain = sorted(map(str, rows.join(found.drop("n"), "k", "left").select("page_id", "k", "last").collect()))
    for hot_rows in (0, 10, 1000):
        assert sorted(map(str, warc.looked_up(rows, "k", found, "last", hot_rows).select("page_id", "k", "last").collect())) == plain
