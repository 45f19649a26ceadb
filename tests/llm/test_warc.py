"""Archives against SQL-like grouping in Python, magic inside payloads, any split size."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op5_warc as m

FAKE = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
HTML = [None, "", FAKE, "é" * 400, "WARC/1.1\r\n" * 50, "WARC/1.1\r\nContent-Length: 9999999\r\n\r\n", "\r\n\r\n"]


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if i is not None:
            first[payload] = min(first.get(payload, i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        f = first.get(payload) if len(payload) >= least else None
        revisit = f is not None and i != f
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://x/{i}\r\nWARC/1.1\r\n é" if i % 3 else None, (HTML[i % 7] or "") + ("" if i % 5 else str(i)) if i % 7 else None) for i in range(200)]
    return out + [(None, "u", "é" * 400), (None, "u", "only without id"), (3, "again", HTML[3])]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("least", [0, 200])
def test_round_trip(spark, rows, split, least):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = m.write_archives(pages, least_bytes=least, archive_bytes=15_000)
    got = m.read_archives(archives, split_bytes=split).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows, least)
    html = {r[0]: (r[2] or "") for r in rows if r[0] is not None}
    assert all(r.payload.decode() == html[r.page_id] for r in got if r.payload is not None and r.page_id is not None and r.page_id != 3)
    assert all((r.url or "").count("\n") == 0 for r in got)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert m.read_archives(m.write_archives(pages)).collect() == []


def test_long_header(spark):
    """A header longer than a read and than a split."""
    rows = [(i, "http://x/" + "p" * 200_000, f"text {i}") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = m.read_archives(m.write_archives(pages), split_bytes=50_000).collect()
    assert sorted(tuple(r)[:5] for r in got) == plain(rows)
