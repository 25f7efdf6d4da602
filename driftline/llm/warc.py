"""WARC archives with revisit resolution.

Headers (page, payload digest, length) are shuffled by digest; the largest page_id of each digest becomes the response, the
others revisits that refer to it. What a digest resolves to goes back to the pages by a broadcast while it is small; of larger
tables the digests of more than a ten-thousandth of the rows go by a broadcast (there are fewer than 10,000 of them) and the others by a
shuffle in which no digest is hot.

The archives are written by Spark's text writer, whose line separator is the end of a WARC record, so they go to any store that
Spark writes to; each record gets fresh headers, and a revisit carries no payload. They are read in the same way, as a
stream of lines of which a record takes as many as its Content-Length says, so that one record at a time is held, whatever
the size of the file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import keep, looked_up, new_path, table

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records that a file holds at most.
FILE_RECORDS = 4_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four characters."""
    digits = F.sha1(data)
    parts = []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), 1, 32).substr((F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def resolve(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds to pages (page_id, url, html): payload, payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response; rows that
    repeat that page_id too are responses. Null html is an empty payload. A null page_id stands below all others.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    group = F.concat_ws(":", "payload_digest", "payload_bytes")
    heads = rows.where(F.col("payload_bytes") >= least).groupBy(group.alias("same")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    heads = keep(heads.where("n > 1"), "heads")  # its size is known before the join: without copies no payload is shuffled
    rows = looked_up(rows.withColumn("same_as", group), "same_as", heads.withColumnRenamed("same", "same_as"), "last").drop("same_as")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("last"))).drop("last")


def record(df: DataFrame) -> DataFrame:
    """The text of one WARC record for each row of resolve(), without its end. Record ids are URNs of page and digest."""

    def urn(page: str) -> Column:
        h = F.md5(F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("null")), "payload_digest").cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    return df.select(
        F.concat(
            F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("page_id")),
            line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
            F.coalesce(line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"),
            F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Deduplicated archives under path: gzip files of WARC 1.1 records."""
    record(resolve(pages, least)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Records:
    """Puts the records of archives together from their pieces between record ends, one record at a time."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.size = self.need = 0

    def add(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records that the piece completes: headers (names in lower case) and content."""
        end = END.encode()
        self.parts += [piece, end]
        self.size += len(piece) + len(end)
        while True:
            if self.head is None:
                data = b"".join(self.parts).lstrip(b"\r\n")
                at = data.find(end)
                if data and not data.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record: {data[:40]!r}")
                self.parts, self.size = [data], len(data)
                if at < 0:
                    return
                self.head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[:at].decode().split("\r\n")[1:]))
                self.parts, self.need = [data[at + len(end) :]], int(self.head["content-length"]) + len(end)
                self.size = len(self.parts[0])
            if self.size < self.need:
                return
            data = b"".join(self.parts)
            if data[self.need - len(end) : self.need] != end:
                raise ValueError(f"a record does not end at its Content-Length of {self.head['content-length']}")
            yield self.head, data[: self.need - len(end)]
            self.head, self.parts, self.size = None, [data[self.need :]], len(data) - self.need

    def close(self) -> None:
        if self.head is not None:
            raise ValueError(f"the last record is cut off before its Content-Length of {self.head['content-length']}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, record_id, record_type, payload_bytes, payload_digest, refers_to_id, content_sha1
    (base32, of what the record carries; null for revisits)."""
    kinds = {"page_id": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string(), "content_sha1": pa.string()}

    def row(head: dict[str, str], content: bytes) -> tuple:
        page, revisit = head.get("warc-page-id"), head["warc-type"] == "revisit"
        carried = None if revisit else base64.b32encode(hashlib.sha1(content).digest()).decode()
        return (None if page is None else int(page), head["warc-record-id"], head["warc-type"], int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to"), carried)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Records()
        for b in batches:
            rows = [row(*found) for piece in b.column(0) for found in open_.add(piece.as_buffer().to_pybytes())]
            if rows:
                yield batch(rows)
        open_.close()

    # a compressed file is one stream, so its pieces come in order
    pieces = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(path)
    return pieces.select("value").mapInArrow(run, "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, content_sha1 string")


def resolved_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact (what is carried has its digest).

    A revisit finds its response by record id; every revisit has one. Repeated responses with one id count once.
    """
    rows = keep(read_archives(spark, path), "records")
    targets = rows.where("refers_to_id is not null").groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("n"))
    found = rows.where("record_type = 'response'").join(targets, "record_id").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.first("n").alias("n"))
    rows = looked_up(rows, "refers_to_id", keep(found.withColumnRenamed("record_id", "refers_to_id"), "targets"), "refers_to")
    intact = F.coalesce(F.col("content_sha1") == F.col("payload_digest"), F.col("refers_to").isNotNull())
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved_archives(spark, path)


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, count(*) OVER (PARTITION BY html) AS n FROM p)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))) % 32, 1), '' ORDER BY j) FROM range(32) AS r(j)) AS payload_digest,
       CASE WHEN n > 1 AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND last IS DISTINCT FROM page_id THEN last END AS refers_to, true AS intact
FROM q
"""
