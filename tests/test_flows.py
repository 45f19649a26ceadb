import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import network
from tidewatch.operators import flows

T0 = 1_742_000_000_000_000
A, B = ("192.168.1.10", 54321), ("10.0.0.1", 80)
SCHEMA = (
    "packet_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "length int, flag_bits int, payload string"
)


def packet(i, ms, a, b, length, bits, proto="TCP"):
    return (i, T0 + round(ms * 1000), a[0], b[0], a[1], b[1], proto, length, bits, None)


def build(spark, data, header=20):
    return flows.with_flags(spark.createDataFrame(data, SCHEMA)).withColumn("header_length", F.lit(header))


def test_six_packets(spark):
    data = [
        packet(1, 0, A, B, 74, 2), packet(2, 1, B, A, 74, 18), packet(3, 2, A, B, 120, 24),
        packet(4, 50, B, A, 850, 24), packet(5, 51, A, B, 54, 17), packet(6, 52, B, A, 54, 17),
    ]
    one, two = flows.flows(build(spark, data, 40)).orderBy("start_us").collect()
    assert one["flow_key"] == "10.0.0.1:80-192.168.1.10:54321-TCP"
    assert (one["src_ip"], one["src_port"], one["dst_ip"], one["dst_port"], one["protocol"]) == (
        "10.0.0.1", 80, "192.168.1.10", 54321, "TCP",
    )
    want = {
        "flow_duration": 0.051, "total_fwd_packets": 2, "total_bwd_packets": 3, "total_length_fwd_packets": 924,
        "total_length_bwd_packets": 248, "fwd_packet_length_max": 850, "fwd_packet_length_min": 74,
        "fwd_packet_length_mean": 462, "fwd_packet_length_std": 388, "bwd_packet_length_max": 120,
        "bwd_packet_length_min": 54, "bwd_packet_length_mean": 248 / 3, "fwd_iat_total": 0.049, "bwd_iat_total": 0.051,
        "fin_flag_count": 1, "syn_flag_count": 2, "psh_flag_count": 2, "ack_flag_count": 4,
        "down_up_ratio": 248 / 924, "average_packet_size": 234.4, "flow_bytes_per_sec": 1172 / 0.051,
        "fwd_header_length": 80, "bwd_header_length": 120, "min_packet_length": 54, "max_packet_length": 850,
    }
    for k, v in want.items():
        assert one[k] == pytest.approx(v), k
    assert two["pkt_count"] == 1 and two["flow_duration"] == 0 and two["flow_bytes_per_sec"] == 0
    assert two["total_fwd_packets"] == 1 and two["bwd_packet_length_max"] == 0 and two["down_up_ratio"] == 0


@pytest.mark.parametrize(("gap_ms", "count"), [(60_000, 2), (59_999, 1), (120_000, 2)])
def test_idle_boundary(spark, gap_ms, count):
    data = [packet(1, 0, A, B, 60, 16), packet(2, gap_ms, A, B, 60, 16)]
    assert flows.flows(build(spark, data)).count() == count


def test_icmp_has_null_ports(spark):
    data = [packet(1, 0, ("1.1.1.1", None), ("2.2.2.2", None), 60, 0, "ICMP")]
    row = flows.flows(build(spark, data)).first()
    assert row["flow_key"] == "1.1.1.1:None-2.2.2.2:None-ICMP" and row["src_port"] is None


def reference(data, idle):
    """Straight per-packet aggregation of the same definition."""
    open_, done = {}, []
    for p in sorted(data, key=lambda x: (x[1], x[0])):
        i, t, s, d, sp, dp, proto, length, bits, _ = p
        fwd = (s, sp) <= (d, dp)
        lo, hi = ((s, sp), (d, dp)) if fwd else ((d, dp), (s, sp))
        key = f"{lo[0]}:{lo[1]}-{hi[0]}:{hi[1]}-{proto}"
        f = open_.get(key)
        if f and t - f["last"] >= idle:
            done.append(open_.pop(key))
            f = None
        f = open_.setdefault(key, {"key": key, "id": i, "start": t, "p": []})
        f["last"] = t
        f["p"].append((t, length, fwd))
        if proto == "TCP" and bits & 5:
            done.append(open_.pop(key))
    out = {}
    for f in [*done, *open_.values()]:
        row = [f["start"], f["last"], len(f["p"])]
        for way in (True, False):
            ts = [t for t, _, w in f["p"] if w == way]
            ls = [n for _, n, w in f["p"] if w == way]
            gaps = np.diff(ts) / 1e6
            row += [len(ls), sum(ls), float(np.std(ls)) if ls else 0.0]
            row += [float(x) for x in (gaps.sum(), gaps.mean(), gaps.std(), gaps.max(), gaps.min())] if len(gaps) else [0.0] * 5
        out[f"{f['key']}@{f['id']}"] = row
    return out


@pytest.mark.parametrize(("chunk_us", "hot_rows"), [(50_000, 0), (3_000_000, 0), (10**12, 0), (50_000, 300), (50_000, 10**6)])
def test_hot_key_over_many_slices(spark, chunk_us, hot_rows):
    """Half the packets on one 5-tuple, slices much shorter than its flows."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(1500):
        hot = rng.random() < 0.5
        a, b = (A, B) if hot else ((f"10.1.0.{rng.integers(6)}", 1000 + int(rng.integers(2))), B)
        if rng.random() < 0.5:
            a, b = b, a
        bits = int(rng.choice([16, 24, 2, 17, 4], p=[0.6, 0.2, 0.17, 0.02, 0.01]))
        data.append(packet(i, float(rng.integers(0, 60_000)), a, b, int(rng.integers(60, 1500)), bits))
    idle = 400_000
    want = reference(data, idle)
    got = flows.flows(build(spark, data), idle, chunk_us, hot_rows=hot_rows).collect()
    assert sum(r["pkt_count"] for r in got) == len(data)
    assert {r["flow_id"] for r in got} == set(want)
    for r in got:
        row = [r["start_us"], r["end_us"], r["pkt_count"]]
        for s in ("fwd", "bwd"):
            row += [r[f"total_{s}_packets"], r[f"total_length_{s}_packets"], r[f"{s}_packet_length_std"]]
            row += [r[f"{s}_iat_{x}"] for x in ("total", "mean", "std", "max", "min")]
        assert row == pytest.approx(want[r["flow_id"]], abs=1e-6), r["flow_id"]
        assert not any(math.isnan(r[f]) or math.isinf(r[f]) for f in flows.FEATURES)
    marked = flows.sessionize(build(spark, data), idle, chunk_us)
    ids = marked.groupBy(F.concat_ws("@", "flow_key", "flow_start.packet_id").alias("f")).count()
    assert {r["f"]: r["count"] for r in ids.collect()} == {k: v[2] for k, v in want.items()}


def test_flag_text(spark):
    df = spark.createDataFrame([(b,) for b in (2, 18, 17, 24, 41, 0, 64)], "b int")
    got = {r[0]: r[1] for r in df.select("b", network.flag_text(F.col("b"))).collect()}
    assert got == {2: "SYN", 18: "SYN-ACK", 17: "FIN-ACK", 24: "PSH-ACK", 41: "FIN-PSH-URG", 0: "0", 64: "64"}


def test_vector_needs_41(spark):
    df = spark.range(1).select(flows.vector_to_map(F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="expected 41"):
        df.collect()


def test_ip_number(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("300",), ("fe80::1",), (None,)], "ip string")
    assert [r[0] for r in df.select(network.ip_number(F.col("ip"))).collect()] == [167772161, None, None, None]
