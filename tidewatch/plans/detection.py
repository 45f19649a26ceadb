"""Packets to correlated alerts in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts, correlate, ensemble, flows, rules
from tidewatch.session import cut_lineage


def signed_flows(
    packets: DataFrame, rule_table: DataFrame, idle_us: int = flows.IDLE_US, chunk_us: int = flows.CHUNK_US
) -> DataFrame:
    """Flows with features and the first rule any of their packets satisfies.

    Rules are applied to packets where they are read; the flow keeps the least rule
    order in the same aggregation that computes its features, so matching adds no
    shuffle.
    """
    rule_table = rules.numbered(rule_table)
    hit = rules.with_hits(flows.with_flags(packets), rule_table)
    first = F.try_element_at("hits", F.lit(1))["rule_order"]
    marked = hit.withColumn("rule_order", first).drop("hits", "payload")
    out = flows.flows(marked, idle_us, chunk_us, ["rule_order"], write_pieces=True)
    return rules.describe_match(out, rule_table)


def detect(
    signed: DataFrame, rf: tuple[Column, Column, Column], lstm: tuple[Column, Column, Column], iforest: tuple[Column, Column],
    window_complete: Column, dedup_us: int = correlate.DEDUP_US, group_us: int = correlate.GROUP_US,
    threshold: float = ensemble.ALERT_AT,
) -> DataFrame:
    """Flows with a signature result and three model results to correlated alerts.

    Models come as column expressions (a model's output or a ``pandas_udf``) on the flow row:
    (predicted class, confidence, is attack), for the anomaly model (is anomaly, confidence).
    Results that stand in tables of their own go through ``ensemble.combine`` first.
    """
    both = ensemble.attached(signed, rf, lstm, iforest, window_complete)
    gated = ensemble.verdicts(both, threshold=threshold).filter("alert")
    events = gated.select(
        F.col("first_packet_id").alias("event_id"), "flow_id", F.col("start_us").alias("t_us"), "src_ip", "dst_ip",
        "src_port", "dst_port", "protocol", "attack_type", "severity", F.col("score").alias("confidence"), "detected_by",
    )
    # everything below reads the gated events more than once
    return alerts.build_alerts(correlate.correlate(cut_lineage(events, "gated"), dedup_us, group_us))
