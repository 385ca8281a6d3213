"""WARC archives: written by tasks, read back by a splittable reader.

Every record is a gzip member of its own.  A reading task gets a byte range,
looks in it for the gzip magic, and takes a place as a record's start only if
the member there decompresses to a WARC header.  It owns the records that start
in its range and reads on past the end for the last of them.  Candidates inside
a record that was read are skipped, as the next start can't lie before its end.

Equal payloads of at least ``least`` bytes are written once: the one with the
largest page id is the response, the others are revisits of it.

Defined cases: a null payload counts as empty; a record with null id is always a
response; rows with equal id and payload are all responses if the id is the
largest; other columns are left out; an empty table gives no file and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import fresh_path, land, table
from caseloom.llm.files import open_new, read_range

LEAST = 1000
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
_URN = "urn:page:"


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "%%%02X" % (ord(c) & 255) for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>",
        ]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(head + block + b"\r\n\r\n") + coder.flush()


def parse(raw: bytes) -> dict | None:
    """Header fields of a record and its block under ``block``; None if it is no WARC record."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in raw[:end].decode(errors="replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            return None
        fields[name.strip().lower()] = value.strip()
    size = int(fields.get("content-length", "-1"))
    if size < 0 or raw[end + 4 + size :] != b"\r\n\r\n":
        return None
    fields["block"] = raw[end + 4 : end + 4 + size]
    return fields


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write one record per row; the landed manifest (uri, size) names the files."""
    payload = F.coalesce(html_col, F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    # only digests that occur again are joined, so payloads move only if those are many
    again = land(long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).filter("n > 1").drop("n"), "repeats")
    revisit = (F.octet_length("payload") >= least) & (F.col("page_id") < F.col("response_id"))
    marked = rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response_id")).alias("refers_to"))

    def save(batches) -> Iterator[pa.RecordBatch]:
        part, stream, uri, size, done = TaskContext.get().partitionId(), None, None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if stream is None:
                    stream, uri = open_new(folder, f"part-{part:06d}")
                raw = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                stream.write(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((uri, size))
                    stream, size = None, 0
        if stream is not None:
            stream.close()
            done.append((uri, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["uri", "size"])

    return land(marked.mapInArrow(save, "uri string, size long"), "archives")


def members(uri: str, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip member starts in [start, end), in order."""
    data, base = b"", start  # bytes of the file from ``base`` on

    def more() -> bool:
        nonlocal data
        at = base + len(data)
        if at >= size:
            return False
        data += read_range(uri, at, min(READ_BYTES, size - at))
        return True

    at = start
    while at < end:
        while (found := data.find(MAGIC, at - base)) < 0 or base + found >= end:
            if found >= 0 or base + len(data) >= end + len(MAGIC) or not more():
                return
        at = base + found
        decoder, out, fed = zlib.decompressobj(31), [], found
        good = True
        while good and not decoder.eof:
            if fed >= len(data) and not more():
                good = False
                break
            try:
                out.append(decoder.decompress(data[fed:]))
            except zlib.error:
                good = False
                break
            fed = len(data)
            if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                good = False
        raw = b"".join(out) if good else b""
        if good and parse(raw) is not None:
            yield raw
            at = base + fed - len(decoder.unused_data)
            data, base = decoder.unused_data, at
        else:
            at += 1


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record."""
    spark = manifest.sparkSession
    ranges = manifest.select("uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, ranges.count() // 4)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for raw in members(r["uri"], r["size"], r["start"], min(r["start"] + range_bytes, r["size"])):
                    f = parse(raw)
                    digest, length = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                    if f["warc-type"] == "response":
                        payload = f["block"].partition(b"\r\n\r\n")[2]
                        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
                        if digest != f["warc-payload-digest"].removeprefix("sha1:"):
                            raise ValueError(f"payload of {f['warc-record-id']} in {r['uri']} does not match its digest")
                    own, other = f["warc-record-id"][1:-1].removeprefix(_URN), f.get("warc-refers-to")
                    rows.append((int(own) if own else None, length, digest, f["warc-type"], int(other[1:-1].removeprefix(_URN)) if other else None, f["warc-target-uri"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)

    return ranges.repartition(tasks).mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read(manifest).drop("url")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n >= 1000) END AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM m
"""
