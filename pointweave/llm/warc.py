"""Web archives: records with segments, written and read back.

Writing.  Every page becomes one record whose block is an HTTP response with chunked transfer
framing around the payload; of pages with equal payloads of at least ``min_revisit`` bytes
the one with the largest id is the response and the others are revisit records, which
hold headers only and name the response's page.  A block longer than ``segment_bytes`` is cut:
the record keeps the first part, and continuation records hold the others under the origin's
identifier with their segment numbers; the last also states the total length.  Spark's text
writer puts the records out, with the format's own record end as the line separator, so
archives go wherever Spark can write; ``file_records`` bounds a file's size.

Reading.  Archives are parsed file by file.  Records in one piece are decoded on the spot;
only the parts of segmented ones are shuffled, grouped by origin identifier, ordered by
segment number, checked against the stated total length, and decoded.  A part that is missing,
a length or a digest that doesn't agree raises ``ValueError``.

Defined cases: a null payload is empty; a null id is left out and read back as null (its
page can be a revisit, never another's original); pages that repeat the largest id of
their payload are all responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """What an HTTP response carries."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + END).encode() + block


def records(identifier: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int, date: str) -> list[bytes]:
    """The record of one page, then its continuations."""
    shared = [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else None), ("WARC-Date", date)]
    own = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", identifier), *shared, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers_to is not None:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
        return [_record([*own, ("Content-Type", "application/http; msgtype=response")], HTTP)]
    block = HTTP + chunked(payload)
    own.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [_record(own, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*own, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{identifier[:-1]}.{k}>"), ("WARC-Segment-Origin-ID", identifier), ("WARC-Segment-Number", k), *last, *shared], part))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of one file, gzip or plain."""
    if archive[:2] == b"\x1f\x8b":
        plain = []
        while archive:  # members in a row
            member = zlib.decompressobj(31)
            plain += [member.decompress(archive), member.flush()]
            archive = member.unused_data
        archive = b"".join(plain)
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = archive[head + 4 : head + 4 + size]
        at = head + 4 + size + 4
        if len(block) != size or archive[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, segment_bytes: int = 32_768, file_records: int = 512, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes every page as a record into the folder."""
    tmp = Scratch(pages.sparkSession, "warc-copies")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    copies = rows.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.count("*").alias("k"), F.max("page_id").alias("first_id")).where("k > 1").drop("k")
    copies = tmp.write(copies, "copies")  # so that its size is known when the join below is planned
    told = rows.join(copies, ["digest", "n"], "left").select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> first_id, null, first_id)").alias("refers_to"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out: list[bytes] = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    out += records(f"<urn:x-page:{task}-{n}>", page_id, url, payload, digest, refers_to, segment_bytes, date)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = told.mapInArrow(made, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


_DECODED = "origin string, page_id long, type string, refers_to long, digest string, payload_bytes long, payload binary, segment int, total long, block binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``)."""

    def decoded(block: bytes, digest: str) -> tuple[int, bytes | None]:
        payload = payload_of(block)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload disagrees with its digest")
        return len(payload), payload if with_payload else None

    schema = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda f, name: int(f[name]) if name in f else None
        for b in batches:
            for archive in b.column(0):
                rows = []
                for f, block in parse(archive.as_py()):
                    segment = whole(f, "warc-segment-number")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    size, payload = (None, None)
                    if f["warc-type"] == "response" and segment is None:
                        size, payload = decoded(block, digest)
                    kind = None if f["warc-type"] == "continuation" else f["warc-type"]
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), whole(f, "x-page-id"), kind, whole(f, "x-refers-to-page-id"), digest, size, payload, segment, whole(f, "warc-segment-total-length"), block if segment else None))
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, page_id, kind, refers_to, digest, size, payload, total, parts in zip(*(c.to_pylist() for c in b.columns)):
                if parts:
                    parts.sort(key=lambda p: p["segment"])
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                        raise ValueError(f"the segments of {origin} don't make {total} bytes")
                    size, payload = decoded(block, digest)
                rows.append((origin, page_id, kind, refers_to, digest, size, payload, None, None, None))
            yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(parsed, _DECODED)
    head = [F.max(c).alias(c) for c in ("page_id", "type", "refers_to", "digest", "payload_bytes", "payload", "total")]
    parts = F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block"))).alias("parts")
    whole = rows.groupBy("origin").agg(*head, parts).mapInArrow(joined, _DECODED)
    tmp = Scratch(spark, "warc-read")
    whole = tmp.write(whole.select("page_id", "type", "refers_to", "digest", "payload_bytes", "payload"), "records")
    lengths = whole.where("type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("their_bytes"))
    revisits = whole.where("type = 'revisit'").join(lengths, ["refers_to", "digest"], "left")
    if with_payload:
        originals = whole.where("type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload").alias("their_payload"))
        revisits = revisits.drop("payload").join(originals, ["refers_to", "digest"], "left").withColumnRenamed("their_payload", "payload")
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"] + ["payload"] * with_payload
    return whole.where("type = 'response'").select(*columns).unionByName(revisits.drop("payload_bytes").withColumnRenamed("their_bytes", "payload_bytes").select(*columns))
