import hashlib
import random

import pytest

from pointweave.llm import warc
from pointweave.sources.scratch import Scratch


def test_framing_round_trips():
    rng = random.Random(1)
    for n in (0, 1, 8191, 8192, 8193, 30_000):
        payload = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(payload)) == payload
        assert warc.payload_of(warc.HTTP + warc.chunked(payload)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_pages_come_back(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("<pé&>\r\n 一\0", k=n))
    big, small = text(90_000), text(400)
    rows = [(i, f"http://x/{i} é\r\n", text(rng.choice([10, 900, 2500, 20_000]))) for i in range(40)]
    rows += [(100 + i, None, big) for i in range(5)] + [(200, "u", small), (201, "u", small), (300, "u", None), (301, "u", ""), (None, "u", big), (None, "u", "lone"), (104, "u", big), (302, "u", "x\r\n\r\nWARC/1.1\r\n" * 90), (303, "u", "x\r\n\r\nWARC/1.1\r\n" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", warc.F.lit("clash")).repartition(3)
    path = Scratch(spark, "t").path("warc")
    warc.write_archives(pages, path, segment_bytes=5000, file_records=7)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    largest = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            largest[t] = max(i, largest.get(t, i))
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        original = largest.get(t, i)
        if original == i:
            original = None
        elif len(raw) < 1000:
            original = None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if original is None else "revisit", original, raw))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_a_missing_segment_is_noticed(spark):
    parts = warc.records("<urn:x-page:0-0>", 1, "u", b"z" * 9000, hashlib.sha1(b"z" * 9000).hexdigest(), None, 4000, "1970-01-01T00:00:00Z")
    assert len(parts) == 3
    path = Scratch(spark, "t").path("warc")
    kept = spark.createDataFrame([(bytearray(p),) for p in (parts[0], parts[2])], "value binary").selectExpr("cast(value as string) value")
    kept.write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark, path).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = Scratch(spark, "t").path("warc")
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).count() == 0
