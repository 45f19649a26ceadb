"""WARC archives of pages, and reading them back by boundary-chain verification.

Writing: payloads are told apart by SHA-1 and length. Of equal payloads the least page id is a
response, the others revisit it; only payloads that occur twice are looked up. Each task writes
archives of about ARCHIVE_BYTES from the rows it has.

Reading: an archive is cut into splits of bytes. A task notes every place in its split that
looks like a record, and the place where that record would end; markers inside payloads give
false candidates. Within a split a candidate is followed to the first place outside. These exits
are then joined with each other, twice as far in each round (pointer jumping), from the start of
each file; what isn't reached is no record. Each split is read from its first true record.

Nulls: a null html is an empty payload, a null url has no target header, a null page id is
larger than any other. All rows with the least id of a payload are responses, repeated rows
included. An empty table has no archives. Extra columns are ignored. One record at a time is
held in memory, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.llm.sharedfiles import each_alone, opened, written
from tidewatch.session import cut_lineage, scratch_path

MAGIC = b"WARC/1.1\r\n"
BREAK = b"\r\n\r\n"
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: dict[str, object]) -> bytes:
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


def target(url: str) -> str:
    """An address as one header line: white space and control characters are percent-encoded."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record, which keeps the response's head but not its payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{ID}{'null' if page_id is None else page_id}>", "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = target(url)
    fields["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    if revisit:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(body)}
    return header(fields) + body + BREAK


def opening() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{ID}info>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": len(body)}) + body + BREAK


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with the id of the response that each one revisits, or null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"),
    )
    # Most payloads occur once; only the others are looked up. Written, so that Spark can split a payload many pages share.
    firsts = cut_lineage(
        keyed.where(F.col("bytes") >= least_bytes)
        .groupBy(F.col("digest").alias("same"), F.col("bytes").alias("size"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 AND first IS NOT NULL")
        .drop("times"),
        "warc-firsts",
    )
    found = keyed.join(firsts, (F.col("digest") == F.col("same")) & (F.col("bytes") == F.col("size")), "left")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; (path, bytes, records) of each archive."""
    folder = scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.warc"
            size = records = 0
            with written(path) as out:
                size += out.write(opening())
                while row is not None and size < archive_bytes:
                    size += out.write(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]))
                    records += 1
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], ["path", "bytes", "records"])

    return cut_lineage(with_first(pages, least_bytes).mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def length_of(head: bytes) -> int | None:
    """Content-Length of a record's header; None if there isn't exactly one."""
    found = [line.partition(b":")[2].strip() for line in head.split(b"\r\n")[1:] if line[:15].lower() == b"content-length:"]
    return int(found[0]) if len(found) == 1 and found[0].isdigit() else None


def head_at(source, at: int, size: int) -> bytes | None:
    """The header that begins at a place, however long."""
    data = source.read_at(min(READ_BYTES, size - at), at)
    while data.startswith(MAGIC):
        end = data.find(BREAK)
        if end >= 0:
            return data[: end + 2]
        if at + len(data) >= size:
            return None
        data += source.read_at(min(len(data), size - at - len(data)), at + len(data))
    return None


def candidates(source, size: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in [start, end) that look like records, and where each one's successor would begin."""
    data = source.read_at(min(size, end + len(MAGIC) - 1) - start, start)
    at, after, seen = [], [], data.find(MAGIC)
    while seen >= 0:
        stop = data.find(BREAK, seen)
        head = data[seen : stop + 2] if stop >= 0 else head_at(source, start + seen, size)
        length = length_of(head) if head is not None else None
        if length is not None and start + seen + len(head) + 2 + length + len(BREAK) <= size:
            at.append(start + seen)
            after.append(start + seen + len(head) + 2 + length + len(BREAK))
        seen = data.find(MAGIC, seen + 1)
    return np.array(at, dtype=np.int64), np.array(after, dtype=np.int64)


def exits(at: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate leaves the split; -1 if it hits no record on the way."""
    out = after.copy()
    place = {a: k for k, a in enumerate(at.tolist())}
    for k in range(len(at) - 1, -1, -1):  # successors lie further on
        if after[k] < end:
            follow = place.get(int(after[k]))
            out[k] = -1 if follow is None else out[follow]
    return out


def reached(jumps: DataFrame, rounds: int) -> DataFrame:
    """(path, at): the candidates that the chain from a file's start enters a split by.

    Round r joins places with the places 2^r splits further on.
    """
    known = jumps.select("path", "at")
    there = known.where("at = 0")
    for r in range(rounds):
        on = there.join(jumps, ["path", "at"]).select("path", F.col("exit").alias("at"))
        there = cut_lineage(there.union(on.join(known, ["path", "at"])).distinct(), f"warc-reached{r}")
        if r < rounds - 1:
            a, b = jumps.alias("a"), jumps.alias("b")
            further = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.exit") == F.col("b.at")))
            jumps = cut_lineage(further.select("a.path", "a.at", "b.exit"), f"warc-jumps{r}")
    return there


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null in revisits)."""
    splits = archives.select(
        "path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["start"] + split_bytes, row["size"])
                with opened(row["path"]) as source:
                    at, after = candidates(source, row["size"], row["start"], end)
                out = exits(at, after, end)
                true = out >= 0
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * int(true.sum()), pa.string()), pa.array(at[true]), pa.array(out[true])], ["path", "at", "exit"])

    jumps = cut_lineage(each_alone(splits).mapInArrow(scan, "path string, at long, exit long"), "warc-candidates")
    largest = archives.agg(F.max("bytes")).first()[0] or 0
    entries = reached(jumps, max(0, -(-largest // split_bytes) - 1).bit_length())
    starts = entries.groupBy("path", F.floor(F.col("at") / split_bytes).alias("split")).agg(F.min("at").alias("at"))
    work = starts.join(archives.select("path", F.col("bytes").alias("size")), "path").select(
        "path", "at", "size", ((F.col("split") + 1) * split_bytes).alias("end")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    at, rows, held = row["at"], [], 0
                    while at < min(row["end"], row["size"]):
                        head = head_at(source, at, row["size"])
                        length = length_of(head)
                        body = source.read_at(length, at + len(head) + 2)
                        at += len(head) + 2 + length + len(BREAK)
                        page = parsed(head, body)
                        if page is not None:
                            rows.append(page)
                            held += len(body)
                        if held > split_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=PAGE)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=PAGE)

    return each_alone(cut_lineage(work, "warc-work")).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


PAGE = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ]
)


def parsed(head: bytes, body: bytes) -> dict | None:
    """The page of a response or revisit record; None for other records."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    number = lambda name: None if (x := fields[name].strip("<>").removeprefix(ID)) == "null" else int(x)
    http, _, payload = body.partition(BREAK)
    if kind == "response":
        found, size = digest(payload), len(payload)
        if f"sha1:{found}" != fields["warc-payload-digest"]:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        found = fields["warc-payload-digest"].removeprefix("sha1:")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": found, "record_type": kind,
        "refers_to": number("warc-refers-to") if kind == "revisit" else None, "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, coalesce(html, '') AS html,
        sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (1 + 5 * g)::INT, 5))::BIGINT >> (15 - 5 * k)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html)
"""


@register("op5_warc", SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return pages.drop("url", "payload")
