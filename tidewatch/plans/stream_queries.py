"""Streams over the given tables, drained and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import correlate, flows, rules
from tidewatch.plans import adapters as ad
from tidewatch.plans import flow_queries as fq
from tidewatch.plans import rule_queries as rq
from tidewatch.plans import verdict_queries as vq
from tidewatch.plans.alert_queries import APPLIED_SQL
from tidewatch.plans.catalog import ORACLES, r, register, rounded
from tidewatch.streaming import streams

A = ad.cte("alerts")


@register("stream_packets", f"WITH {ad.cte('packets')} SELECT packet_id, src_ip, dst_ip, length FROM packets")
def packets(spark, sf):
    s, _ = streams.replay(ad.load(spark, sf, "packets"), end=False)
    return streams.drained(s.select("packet_id", "src_ip", "dst_ip", "length"), "packets")


@register(
    "stream_flows",
    f"WITH {fq.FLOWS_SQL} SELECT flow_id, start_us, end_us, pkt_count, {', '.join(r(f) for f in flows.FEATURES)} FROM flows",
)
def stream_flows(spark, sf):
    s, delay = streams.replay(ad.load(spark, sf, "packets"))
    out = streams.drained(streams.flow_stream(s, fq.IDLE, delay), "flows")
    return rounded(out.select("flow_id", "start_us", "end_us", "pkt_count", *flows.FEATURES))


@register(
    "stream_dedup",
    f"WITH RECURSIVE {vq.EMITTED_SQL} SELECT event_id, src_ip, dst_ip, attack_type, t_us, dup_count FROM emitted",
)
def dedup(spark, sf):
    """Every window opens with an alert and ends with the number of events it held back."""
    s, delay = streams.replay(vq.gated(spark, sf).select("event_id", "t_us", "src_ip", "dst_ip", "attack_type"))
    out = streams.drained(streams.duplicate_stream(s, vq.DEDUP, delay), "dedup")
    opened = out.filter("kind = 'alert'").select("event_id")
    return out.filter("kind = 'closed'").join(opened, "event_id").select("event_id", "src_ip", "dst_ip", "attack_type", "t_us", "dup_count")


def chained(spark, sf, group_us):
    """What the three correlation operators give one behind the other, on events out of order."""
    s, delay = streams.replay(vq.gated(spark, sf).select("event_id", "t_us", "src_ip", "dst_ip", "attack_type", "severity"))
    return streams.drained(streams.chain_stream(s, vq.DEDUP, group_us, delay), "chains")


def group_id():
    return F.md5(F.concat_ws("|", "src_ip", F.col("group_start_us").cast("string"))).alias("group_id")


@register("stream_groups", f"WITH RECURSIVE {vq.grouped_sql(vq.SHORT_GROUP)} SELECT event_id, src_ip, attack_type, group_id, group_start_us, is_new_group FROM grouped")
def stream_groups(spark, sf):
    s, delay = streams.replay(vq.gated(spark, sf).select("event_id", "t_us", "src_ip", "dst_ip", "attack_type", "severity"))
    out = streams.drained(streams.group_stream(s, vq.DEDUP, vq.SHORT_GROUP, delay), "groups")
    return out.filter("kind = 'alert'").select("event_id", "src_ip", "attack_type", group_id(), "group_start_us", "is_new_group")


@register("stream_chains", vq.chain_sql(vq.GROUP))
def stream_chains(spark, sf):
    """Each alert when it came, with the number of duplicates that its window held back when it closed."""
    out = chained(spark, sf, vq.GROUP)
    closed = out.filter("kind = 'closed'").select("event_id", "dup_count")
    return out.filter("kind = 'alert'").drop("dup_count").join(closed, "event_id").select(
        "event_id", group_id(), "is_new_group", "dup_count", F.array_join("chain_attack_types", ",").alias("types"),
        "attack_chain", correlate.rank_severity(F.col("composite_rank")).alias("composite_severity"),
    )


@register("stream_correlation_counters", ORACLES["cor_counters"])
def stream_correlation_counters(spark, sf):
    return streams.correlation_counters(chained(spark, sf, vq.SHORT_GROUP), vq.AT)


HELD = "event_id % 7 = 3"


@register(
    "stream_late_rows",
    f"""WITH RECURSIVE {vq.GATED_SQL}, early AS (SELECT * FROM gated WHERE NOT ({HELD})), {vq.anchor_sql("early", vq.correlate.DEDUP_KEY, vq.DEDUP, "marked")}
SELECT 'late' AS part, event_id, t_us, 1 AS n FROM gated WHERE {HELD}
UNION ALL SELECT 'window', min(event_id) FILTER (opens), anchor, count(*) FROM marked GROUP BY src_ip, dst_ip, attack_type, anchor""",
)
def stream_late_rows(spark, sf):
    """Events that come after the watermark go to a side table; windows and late rows add up to the input."""
    events = vq.gated(spark, sf).select("event_id", "t_us", "src_ip", "dst_ip", "attack_type")
    s, delay = streams.replay(events.filter(f"NOT ({HELD})"), held=events.filter(HELD))
    on_time, late = streams.split_late(streams.drained(streams.duplicate_stream(s, vq.DEDUP, delay, late=True), "late"))
    windows = on_time.filter("kind = 'closed'").select(F.lit("window").alias("part"), "event_id", "t_us", (F.col("dup_count") + 1).alias("n"))
    return late.select(F.lit("late").alias("part"), F.col("id").alias("event_id"), "t_us", F.lit(1).cast("long").alias("n")).union(windows)


@register("stream_rate_threshold", ORACLES["sig_rate_threshold"])
def stream_rate_threshold(spark, sf):
    t = rq.rule_table(spark)
    matches = rules.all_matches(rq.packets(spark, sf), t).select("rule_id", "t_us", "packet_id", "src_ip", "dst_ip")
    s, delay = streams.replay(matches)
    return streams.drained(streams.rate_stream(s, t, delay), "rates")


@register(
    "stream_recent_vectors",
    f"""WITH {ad.cte("scores")}, w AS (SELECT event_id, list(rf_conf) OVER (PARTITION BY src_ip ORDER BY t_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM scores)
SELECT event_id, {r("list_sum(l)", "total")}, len(l) = 10 AS window_complete FROM w""",
)
def recent_vectors(spark, sf):
    s = ad.load(spark, sf, "scores").select("event_id", "t_us", "src_ip", F.array("rf_conf", "if_conf").alias("vector"))
    s, delay = streams.replay(s)
    out = streams.drained(streams.recent_stream(s, 10, 40 * 86_400_000, delay), "recent")
    total = F.aggregate("recent", F.lit(0.0), lambda a, v: a + v[0])
    return rounded(out.select("event_id", total.alias("total"), "window_complete"))


@register(
    "stream_workflow",
    f"WITH RECURSIVE {APPLIED_SQL} SELECT action_id, alert_id, previous_status, accepted, new_status FROM applied",
)
def workflow(spark, sf):
    s, delay = streams.replay(ad.load(spark, sf, "actions"))
    return streams.drained(streams.workflow_stream(s, delay), "workflow")


@register(
    "stream_live_counters",
    f"""WITH {A}, c AS (SELECT t_us // 3600000000 * 3600000000 AS window_us, severity, count(*) AS n FROM alerts GROUP BY ALL)
SELECT * FROM c""",
)
def live_counters(spark, sf):
    s, delay = streams.replay(ad.load(spark, sf, "alerts").select("t_us", "severity", "alert_id"))
    return streams.drained(streams.live_counters(s, delay=delay), "counters")


@register("stream_insert", f"WITH {A} SELECT alert_id, t_us, severity FROM alerts")
def insert(spark, sf):
    """The same alerts arrive three times; each is stored once."""
    a = ad.load(spark, sf, "alerts").select("alert_id", "t_us", "severity")
    s, _ = streams.replay(a.unionByName(a), 2, end=False)
    return streams.drained(s, "insert", streams.insert_stream).select("alert_id", "t_us", "severity")


@register("stream_alert_events", f"WITH {A} SELECT alert_id, severity, status FROM alerts")
def alert_events(spark, sf):
    s, _ = streams.replay(ad.load(spark, sf, "alerts"), 2, end=False)
    out = streams.drained(alert_ops.new_alert_events(s), "events")
    j = F.from_json("payload", "severity string, status string")
    return out.select("alert_id", j.alias("j")).select("alert_id", "j.*")


@register("stream_read_after", f"WITH {A} SELECT event_id, alert_id FROM alerts WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def read_after(spark, sf):
    return streams.read_after(ad.load(spark, sf, "alerts"), 500, 200).select("event_id", "alert_id")


@register("stream_after", f"WITH {A} SELECT event_id, alert_id FROM alerts WHERE event_id > 500")
def after(spark, sf):
    s, _ = streams.replay(ad.load(spark, sf, "alerts").select("event_id", "alert_id", "t_us"), end=False)
    return streams.drained(streams.stream_after(s, 500).select("event_id", "alert_id"), "after")
