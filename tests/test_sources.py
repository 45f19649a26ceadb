import struct

from pyspark.sql import functions as F

from tidewatch.sources import captures, tables
from tidewatch.streaming import streams


def eth(kind, body):
    return b"\0" * 12 + struct.pack(">H", kind) + body


def ipv4(proto, body):
    return struct.pack(">BBHIBBH4s4s", 0x45, 0, 20 + len(body), 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body


def ipv6(nxt, body, src, dst):
    return struct.pack(">IHBB", 6 << 28, len(body), nxt, 64) + src + dst + body


TCP = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x12, 0, 0, 0)
UDP = struct.pack(">HHHH", 53, 5353, 11, 0)
LOOP = b"\0" * 15 + b"\1"
LINK = bytes.fromhex("fe80000000000000020000fffe000001")
FULL = bytes.fromhex("20010db8000000010000000000000002")
FRAMES = [
    eth(0x0800, ipv4(6, TCP + b"GET /")) + b"\0\0\0",
    eth(0x0800, ipv4(17, UDP + b"abc")),
    eth(0x0800, ipv4(1, b"\x08\0\0\0\0\0\0\0ping")),
    eth(0x86DD, ipv6(6, TCP, LINK, LOOP)),
    eth(0x86DD, ipv6(58, b"\x80\0\0\0", FULL, LINK)),
    eth(0x0806, b"\0" * 28),
    b"",
    eth(0x0800, ipv4(47, b"gre")),
    eth(0x8100, b"\0\1" + struct.pack(">H", 0x0800) + ipv4(17, UDP + b"xyz")),
]


def capture(order, magic):
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 1000 + i, 5, len(f), len(f)) + f
    return out


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture("<", b"\xd4\xc3\xb2\xa1"))
    (tmp_path / "b.pcap").write_bytes(capture(">", b"\xa1\xb2\xc3\xd4") + b"\0" * 7)
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    frames = captures.read_captures(spark, str(tmp_path))
    # the cut record of b and all of c count as malformed
    assert frames.filter("frame IS NOT NULL").count() == 2 * len(FRAMES) and frames.count() == 2 * len(FRAMES) + 2
    assert tuple(captures.capture_counts(frames).first()) == (20, 14, 6)
    ids = [r["packet_id"] for r in captures.with_packet_id(captures.decode_frames(frames)).orderBy("path", "seq").collect()]
    assert ids == sorted(set(ids)) and len(ids) == 14
    got = {r["seq"]: r for r in captures.decode_frames(frames.filter(F.col("path").endswith("a.pcap"))).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7, 8]
    r = got[0]
    assert (r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["protocol"], r["flag_bits"]) == ("10.0.0.1", "10.0.0.2", 1234, 80, "TCP", 18)
    assert bytes(r["payload"]) == b"GET /" and r["length"] == len(FRAMES[0]) and r["t_us"] == 1_000_000_005
    assert bytes(got[1]["payload"]) == b"abc" and got[1]["protocol"] == "UDP" and got[1]["flag_bits"] is None
    assert got[2]["protocol"] == "ICMP" and got[2]["icmp_type"] == 8 and bytes(got[2]["payload"]) == b"ping" and got[2]["src_port"] is None
    assert (got[3]["src_ip"], got[3]["dst_ip"]) == ("fe80::200:ff:fe00:1", "::1") and got[3]["protocol"] == "TCP"
    assert got[4]["src_ip"] == "2001:db8:0:1::2" and got[4]["protocol"] == "ICMPv6" and bytes(got[4]["payload"]) == b""
    assert got[7]["protocol"] == "OTHER"
    assert bytes(got[8]["payload"]) == b"xyz" and got[8]["dst_port"] == 5353


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "one.csv").write_text(" Flow Duration, LABEL_X, Label\n1.5,9,BENIGN\nInfinity,9,DoS Hulk\n")
    (tmp_path / "two.csv").write_text("flow duration,Total Fwd Packets,Label\nx,4,Bot\n")
    paths = [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]
    got = tables.read_labelled_csv(spark, paths, ["Flow Duration", "Total Fwd Packets"]).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [("one.csv", 1.5, 0.0, "BENIGN"), ("one.csv", float("inf"), 0.0, "DoS Hulk"), ("two.csv", None, 4.0, "Bot")], key=repr
    )


def test_unequal_headers_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x0,x1,Label\n1,2,BENIGN\n")
    (tmp_path / "b.csv").write_text('Label,"x1 ", X0\nBot,5,4\n')
    got = tables.read_labelled_csv(spark, [str(tmp_path)], ["x0", "x1", "x2"]).collect()
    assert sorted(tuple(r) for r in got) == [("a.csv", 1.0, 2.0, 0.0, "BENIGN"), ("b.csv", 4.0, 5.0, 0.0, "Bot")]


def test_stream_over_many_triggers_equals_batch(spark):
    """Duplicate windows over micro-batches whose rows come out of order."""
    rows = [(i, 10**15 + i * 20_000_000, "a", "b", "DoS" if i % 3 else "PortScan") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, src_ip string, dst_ip string, attack_type string")
    s, delay = streams.replay(df, 8, 2)
    got = streams.drained(streams.duplicate_stream(s, delay=delay), "t").collect()
    anchor, opener, held = {}, {}, {}
    for i, t, _, _, kind in rows:
        if kind not in anchor or t > anchor[kind] + 60_000_000:
            anchor[kind], opener[kind] = t, i
            held[i] = -1
        held[opener[kind]] += 1
    assert sorted(r["event_id"] for r in got if r["kind"] == "alert") == sorted(held)
    assert {r["event_id"]: r["dup_count"] for r in got if r["kind"] == "closed"} == held


def test_statistics_merge_without_loss():
    import numpy as np

    from tidewatch.streaming import processors as pr

    x = 1e9 + np.random.default_rng(1).random(5000)
    parts = [pr.stats(p) for p in np.array_split(x, 37)] + [pr.NOTHING]
    total = parts[0]
    for p in parts[1:]:
        total = pr.joined(total, p)
    assert abs(total[2] / 5000 - x.var()) < 1e-9 and total[0] == 5000 and abs(total[1] - x.mean()) < 1e-6
