"""Capture files to packet rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Classic capture magic numbers -> (byte order, fractions per second).
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
FRAME_SCHEMA = "path string, seq long, t_us long, frame binary"


def _records(content: bytes) -> Iterator[tuple[int | None, bytes | None]]:
    """(time, frame) of each record; (None, None) for an unknown format or a record that is cut off."""
    order = MAGIC.get(content[:4])
    if order is None:
        yield None, None
        return
    end, parts = order
    at = 24
    while at < len(content):
        if at + 16 > len(content):
            yield None, None
            return
        sec, frac, size, _ = struct.unpack_from(end + "IIII", content, at)
        at += 16
        if at + size > len(content):
            yield None, None
            return
        yield sec * 1_000_000 + frac * 1_000_000 // parts, content[at : at + size]
        at += size


def split_captures(files: DataFrame, batch: int = 5000) -> DataFrame:
    """(path, content) rows to one row per record, a file at a time, in batches.

    What can't be read of a file is a row without time and frame, which counts as malformed.
    """

    def rows(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=["path", "seq", "t_us", "frame"]).astype({"t_us": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                held = []
                for seq, (t, frame) in enumerate(_records(bytes(content))):
                    held.append((path, seq, t, frame))
                    if len(held) == batch:
                        yield rows(held)
                        held = []
                if held:
                    yield rows(held)

    return files.select("path", "content").mapInPandas(run, FRAME_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All capture files below a path; files are the unit of parallelism."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)
    return split_captures(files)


def with_packet_id(packets: DataFrame) -> DataFrame:
    """``packet_id`` from (path, seq), different for records of different files, in path and record order."""
    number = F.row_number().over(Window.orderBy("path"))  # one row per file
    files = packets.select("path").distinct().withColumn("__file", number - 1)
    return packets.join(files, "path").withColumn("packet_id", F.col("__file") * (1 << 40) + F.col("seq")).drop("__file")


def _num(frame: Column, at: Column | int, size: int) -> Column:
    """Unsigned number at a 0-based byte offset."""
    pos = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(frame, pos, F.lit(size))), 16, 10).cast("long")


def _ipv6_text(frame: Column, at: Column) -> Column:
    """Eight groups without leading zeros, the longest run of zeros as ``::``."""
    groups = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.regexp_replace(F.lower(F.hex(F.substring(frame, at + 1 + i * 2, F.lit(2)))), "^0{1,3}", ""),
        ),
        ":",
    )
    out = groups
    for run in range(2, 9):
        zeros = "0" + ":0" * (run - 1)
        found = groups.rlike(f"(^|:){zeros}(:|$)")
        head = F.regexp_extract(groups, f"^(.*?)(^|:){zeros}(:|$)(.*)$", 1)
        tail = F.regexp_extract(groups, f"^(.*?)(^|:){zeros}(:|$)(.*)$", 4)
        out = F.when(found, F.concat(head, F.lit("::"), tail)).otherwise(out)
    return out


def decode_frames(frames: DataFrame) -> DataFrame:
    """Ethernet frames to packet columns; frames that are not IP are dropped.

    Plain column expressions over the bytes: addresses, protocol, ports, flag bits,
    ICMP type, payload, length. One VLAN tag is skipped.
    """
    f = F.col("frame")
    tagged = _num(f, 12, 2) == 0x8100
    df = frames.withColumn("__l3", F.when(tagged, 18).otherwise(14)).withColumn(
        "__kind", F.when(tagged, _num(f, 16, 2)).otherwise(_num(f, 12, 2))
    )
    l3 = F.col("__l3")
    v4, v6 = F.col("__kind") == 0x0800, F.col("__kind") == 0x86DD
    df = df.filter((v4 & (F.octet_length(f) >= l3 + 20)) | (v6 & (F.octet_length(f) >= l3 + 40)))
    head = F.when(v4, _num(f, l3, 1).bitwiseAND(15) * 4).otherwise(F.lit(40))
    df = df.withColumns(
        {
            "__l4": (l3 + head).cast("int"),
            "__proto": F.when(v4, _num(f, l3 + 9, 1)).otherwise(_num(f, l3 + 6, 1)),
            "__end": (l3 + F.when(v4, _num(f, l3 + 2, 2)).otherwise(_num(f, l3 + 4, 2) + 40)).cast("int"),
        }
    )
    l4, proto = F.col("__l4"), F.col("__proto")
    quad = lambda off: F.concat_ws(".", *[_num(f, l3 + off + i, 1).cast("string") for i in range(4)])
    has = F.octet_length(f) - l4
    tcp, udp = (proto == 6) & (has >= 20), (proto == 17) & (has >= 8)
    icmp = (proto == 1) & (has >= 4)
    name = F.when(tcp, "TCP").when(udp, "UDP").when(icmp, "ICMP").when(proto == 58, "ICMPv6").otherwise("OTHER")
    start = (
        F.when(tcp, l4 + F.shiftright(_num(f, l4 + 12, 1), 4).cast("int") * 4).when(udp, l4 + 8).when(icmp, l4 + 8)
    )
    body = F.substring(f, start + 1, F.greatest(F.least(F.col("__end"), F.octet_length(f)) - start, F.lit(0)).cast("int"))
    return df.select(
        *frames.columns,
        F.when(v4, quad(12)).otherwise(_ipv6_text(f, l3 + 8)).alias("src_ip"),
        F.when(v4, quad(16)).otherwise(_ipv6_text(f, l3 + 24)).alias("dst_ip"),
        F.when(tcp | udp, _num(f, l4, 2).cast("int")).alias("src_port"),
        F.when(tcp | udp, _num(f, l4 + 2, 2).cast("int")).alias("dst_port"),
        name.alias("protocol"),
        F.octet_length(f).alias("length"),
        F.when(tcp, _num(f, l4 + 13, 1).bitwiseAND(63).cast("int")).alias("flag_bits"),
        F.when(icmp, _num(f, l4, 1).cast("int")).alias("icmp_type"),
        F.coalesce(body, F.lit(b"")).alias("payload"),
    )


def capture_counts(frames: DataFrame) -> DataFrame:
    """Captured, decoded and malformed frames."""
    ok = decode_frames(frames).agg(F.count(F.lit(1)).alias("enqueued"))
    return frames.agg(F.count(F.lit(1)).alias("captured")).crossJoin(ok).withColumn(
        "malformed", F.col("captured") - F.col("enqueued")
    )
