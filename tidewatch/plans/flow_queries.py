"""Packets to flows: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import network
from tidewatch.operators import flows
from tidewatch.plans import adapters as ad
from tidewatch.plans.catalog import r, register, rounded

# driver events are hours apart, so flows idle out after a day here
IDLE = 24 * 3600 * 1_000_000
CHUNK = 24 * 3600 * 1_000_000

FLAG_TEXT_SQL = """CASE flag_bits WHEN 2 THEN 'SYN' WHEN 17 THEN 'FIN-ACK' WHEN 4 THEN 'RST'
 WHEN 24 THEN 'PSH-ACK' WHEN 16 THEN 'ACK' END"""

KEYED_SQL = f"""{ad.cte("packets")},
flagged AS (SELECT *, CASE WHEN protocol = 'TCP' THEN {FLAG_TEXT_SQL} END AS tcp_flags FROM packets),
keyed AS (SELECT *,
  protocol = 'TCP' AND flag_bits & 1 > 0 AS flag_fin, protocol = 'TCP' AND flag_bits & 2 > 0 AS flag_syn,
  protocol = 'TCP' AND flag_bits & 4 > 0 AS flag_rst, protocol = 'TCP' AND flag_bits & 8 > 0 AS flag_psh,
  protocol = 'TCP' AND flag_bits & 16 > 0 AS flag_ack, protocol = 'TCP' AND flag_bits & 32 > 0 AS flag_urg,
  (src_ip < dst_ip OR (src_ip = dst_ip AND coalesce(src_port, -1) <= coalesce(dst_port, -1))) AS is_forward,
  src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), 'None') AS a,
  dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), 'None') AS b
  FROM flagged),
named AS (SELECT *, CASE WHEN is_forward THEN a || '-' || b ELSE b || '-' || a END || '-' || protocol AS flow_key FROM keyed)"""

SESSIONS_SQL = f"""{KEYED_SQL},
lagged AS (SELECT *, lag(t_us) OVER w AS last_t, lag(flag_fin OR flag_rst) OVER w AS last_ends
  FROM named WINDOW w AS (PARTITION BY flow_key ORDER BY t_us, packet_id)),
marked AS (SELECT *, CASE WHEN last_t IS NULL OR last_ends OR t_us - last_t >= {IDLE}::BIGINT THEN 1 ELSE 0 END AS s FROM lagged),
seqd AS (SELECT *, sum(s) OVER (PARTITION BY flow_key ORDER BY t_us, packet_id) AS seq FROM marked),
sessions AS (SELECT *, first_value(t_us) OVER w AS start_us, first_value(packet_id) OVER w AS first_packet_id,
  t_us - lag(t_us) OVER (PARTITION BY flow_key, seq, is_forward ORDER BY t_us, packet_id) AS iat_us
  FROM seqd WINDOW w AS (PARTITION BY flow_key, seq ORDER BY t_us, packet_id))"""


def _dir_stats(p, cond):
    return f"""
  coalesce(max(length) FILTER ({cond}), 0)::DOUBLE AS {p}_packet_length_max,
  coalesce(min(length) FILTER ({cond}), 0)::DOUBLE AS {p}_packet_length_min,
  coalesce(avg(length) FILTER ({cond}), 0) AS {p}_packet_length_mean,
  coalesce(stddev_pop(length) FILTER ({cond}), 0) AS {p}_packet_length_std,
  coalesce(sum(iat_us) FILTER ({cond}) / 1e6, 0) AS {p}_iat_total,
  coalesce(avg(iat_us) FILTER ({cond}) / 1e6, 0) AS {p}_iat_mean,
  coalesce(stddev_pop(iat_us) FILTER ({cond}) / 1e6, 0) AS {p}_iat_std,
  coalesce(max(iat_us) FILTER ({cond}) / 1e6, 0) AS {p}_iat_max,
  coalesce(min(iat_us) FILTER ({cond}) / 1e6, 0) AS {p}_iat_min,"""


FLOWS_SQL = f"""{SESSIONS_SQL},
agg AS (SELECT flow_key, start_us, first_packet_id,
  min(CASE WHEN is_forward THEN src_ip ELSE dst_ip END) AS src_ip,
  min(CASE WHEN is_forward THEN dst_ip ELSE src_ip END) AS dst_ip,
  min(CASE WHEN is_forward THEN src_port ELSE dst_port END) AS src_port,
  min(CASE WHEN is_forward THEN dst_port ELSE src_port END) AS dst_port,
  min(protocol) AS protocol, max(t_us) AS end_us, count(*) AS pkt_count,
  sum(length)::BIGINT AS byte_count, bit_or(flag_bits) AS flag_union,
  (max(t_us) - start_us) / 1e6 AS flow_duration,
  count(*) FILTER (is_forward)::DOUBLE AS total_fwd_packets,
  count(*) FILTER (NOT is_forward)::DOUBLE AS total_bwd_packets,
  coalesce(sum(length) FILTER (is_forward), 0)::DOUBLE AS total_length_fwd_packets,
  coalesce(sum(length) FILTER (NOT is_forward), 0)::DOUBLE AS total_length_bwd_packets,
  {_dir_stats("fwd", "is_forward")} {_dir_stats("bwd", "NOT is_forward")}
  count(*) FILTER (flag_fin)::DOUBLE AS fin_flag_count, count(*) FILTER (flag_syn)::DOUBLE AS syn_flag_count,
  count(*) FILTER (flag_rst)::DOUBLE AS rst_flag_count, count(*) FILTER (flag_psh)::DOUBLE AS psh_flag_count,
  count(*) FILTER (flag_ack)::DOUBLE AS ack_flag_count, count(*) FILTER (flag_urg)::DOUBLE AS urg_flag_count,
  20.0::DOUBLE * count(*) FILTER (is_forward) AS fwd_header_length,
  20.0::DOUBLE * count(*) FILTER (NOT is_forward) AS bwd_header_length,
  min(length)::DOUBLE AS min_packet_length, max(length)::DOUBLE AS max_packet_length
  FROM sessions GROUP BY flow_key, start_us, first_packet_id),
flows AS (SELECT *, flow_key || '@' || first_packet_id AS flow_id,
  CASE WHEN flow_duration > 0 THEN byte_count / flow_duration ELSE 0 END AS flow_bytes_per_sec,
  CASE WHEN flow_duration > 0 THEN pkt_count / flow_duration ELSE 0 END AS flow_packets_per_sec,
  CASE WHEN total_length_fwd_packets > 0 THEN total_length_bwd_packets / total_length_fwd_packets ELSE 0 END AS down_up_ratio,
  byte_count / pkt_count AS average_packet_size,
  fwd_packet_length_mean AS avg_fwd_segment_size, bwd_packet_length_mean AS avg_bwd_segment_size,
  CASE WHEN flow_duration > 0 THEN total_fwd_packets / flow_duration ELSE 0 END AS fwd_packets_per_sec,
  CASE WHEN flow_duration > 0 THEN total_bwd_packets / flow_duration ELSE 0 END AS bwd_packets_per_sec
  FROM agg)"""

ROUNDED = ", ".join(r(f) for f in flows.FEATURES)


def packets(spark, sf):
    return flows.with_flags(ad.load(spark, sf, "packets"))


def flow_table(spark, sf):
    return flows.flows(packets(spark, sf), IDLE, CHUNK)


@register(
    "flow_flag_text",
    f"""WITH {ad.cte("packets")}, bits AS (SELECT packet_id, (packet_id % 70)::INT AS flag_bits FROM packets),
n AS (SELECT *, concat_ws('-', CASE WHEN flag_bits & 1 > 0 THEN 'FIN' END, CASE WHEN flag_bits & 2 > 0 THEN 'SYN' END,
 CASE WHEN flag_bits & 4 > 0 THEN 'RST' END, CASE WHEN flag_bits & 8 > 0 THEN 'PSH' END,
 CASE WHEN flag_bits & 16 > 0 THEN 'ACK' END, CASE WHEN flag_bits & 32 > 0 THEN 'URG' END) AS j FROM bits)
SELECT packet_id, CASE WHEN flag_bits = 18 THEN 'SYN-ACK' WHEN flag_bits = 17 THEN 'FIN-ACK' WHEN j = '' THEN flag_bits::VARCHAR ELSE j END AS tcp_flags FROM n""",
)
def flag_text(spark, sf):
    bits = (F.col("packet_id") % 70).cast("int")
    return ad.load(spark, sf, "packets").select("packet_id", network.flag_text(bits).alias("tcp_flags"))


@register(
    "flow_packet_records",
    f"""WITH {KEYED_SQL} SELECT packet_id, tcp_flags, flag_fin, flag_syn, flag_rst, flag_psh, flag_ack, flag_urg,
 20 AS header_length, coalesce(strlen(payload), 0)::INT AS payload_length FROM named""",
)
def packet_records(spark, sf):
    return packets(spark, sf).select(
        "packet_id", "tcp_flags", "flag_fin", "flag_syn", "flag_rst", "flag_psh", "flag_ack",
        "flag_urg", "header_length", "payload_length",
    )


@register("flow_keys", f"WITH {KEYED_SQL} SELECT packet_id, flow_key, is_forward FROM named")
def flow_keys(spark, sf):
    return flows.with_flow_key(packets(spark, sf)).select("packet_id", "flow_key", "is_forward")


@register(
    "flow_sessions",
    f"WITH {SESSIONS_SQL} SELECT packet_id, flow_key, start_us, first_packet_id, iat_us FROM sessions",
)
def flow_sessions(spark, sf):
    return flows.sessionize(packets(spark, sf), IDLE, CHUNK).select(
        "packet_id", "flow_key", F.col("flow_start.t_us").alias("start_us"),
        F.col("flow_start.packet_id").alias("first_packet_id"), "iat_us",
    )


@register("flow_features", f"WITH {FLOWS_SQL} SELECT flow_id, src_ip, dst_ip, src_port, dst_port, protocol, start_us, end_us, {ROUNDED} FROM flows")
def flow_features(spark, sf):
    return rounded(flow_table(spark, sf)).drop("flow_key", "first_packet_id", "pkt_count", "byte_count", "flag_union")


@register("flow_summary", f"WITH {FLOWS_SQL} SELECT flow_id, pkt_count, byte_count, flag_union, start_us, end_us FROM flows")
def flow_summary(spark, sf):
    return flow_table(spark, sf).select("flow_id", "pkt_count", "byte_count", "flag_union", "start_us", "end_us")


@register(
    "flow_vector_map",
    f"""WITH {FLOWS_SQL} SELECT flow_id, {r('flow_duration', 'duration')}, {r('max_packet_length', 'longest')},
 41 AS n FROM flows""",
)
def flow_vector_map(spark, sf):
    named = flows.feature_vector(flow_table(spark, sf)).select(
        "flow_id", flows.vector_to_map(F.col("features")).alias("m")
    )
    return rounded(
        named.select(
            "flow_id", F.col("m")["flow_duration"].alias("duration"),
            F.col("m")["max_packet_length"].alias("longest"), F.size("m").alias("n"),
        )
    )


@register(
    "flow_json_containment",
    f"""WITH {FLOWS_SQL} SELECT flow_id FROM flows WHERE syn_flag_count = 1 AND fin_flag_count = 0""",
)
def flow_json_containment(spark, sf):
    stored = flows.features_json(flow_table(spark, sf)).select("flow_id", "feature_vector")
    return stored.filter(
        flows.json_contains("feature_vector", syn_flag_count=1, fin_flag_count=0)
    ).select("flow_id")


@register(
    "flow_counters",
    f"""WITH {FLOWS_SQL}, p AS (SELECT count(*) AS captured, count(src_ip) AS enqueued, count(*) - count(src_ip) AS malformed,
 {r('(max(t_us) - min(t_us)) / 1e6', 'seconds')} FROM packets)
SELECT p.*, (SELECT count(*) FROM flows) AS flows, (SELECT sum(pkt_count)::BIGINT FROM flows) AS flow_packets,
 {r('(SELECT count(*) FROM flows) / seconds', 'flows_per_sec')} FROM p""",
)
def flow_counters(spark, sf):
    return rounded(flows.capture_counters(packets(spark, sf), flow_table(spark, sf)))


UNKNOWN_LENGTH = "CASE WHEN packet_id % 2 = 0 THEN NULL ELSE length END"
FROM_LENGTH = [f"{s}_packet_length_{k}" for s in ("fwd", "bwd") for k in ("max", "min", "mean", "std")] + ["min_packet_length", "max_packet_length", "flow_bytes_per_sec"]


@register(
    "flow_zero_on_error",
    "WITH "
    + FLOWS_SQL.replace("AS tcp_flags FROM packets)", f"AS tcp_flags FROM (SELECT * REPLACE ({UNKNOWN_LENGTH} AS length) FROM packets))")
    + f" SELECT flow_id, {', '.join(r(f'coalesce({f}, 0)', f) for f in FROM_LENGTH)} FROM flows",
)
def flow_zero_on_error(spark, sf):
    """A feature that cannot be computed, here for want of lengths, becomes 0.0; the flow stays."""
    got = flows.flows(packets(spark, sf).withColumn("length", F.expr(UNKNOWN_LENGTH)), IDLE, CHUNK)
    return rounded(got.select("flow_id", *FROM_LENGTH))
