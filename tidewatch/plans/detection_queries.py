"""The whole way from packets to alerts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans import adapters as ad
from tidewatch.plans import detection
from tidewatch.plans import flow_queries as fq
from tidewatch.plans import verdict_queries as vq
from tidewatch.plans.catalog import register
from tidewatch.plans.rule_queries import HITS_SQL, RULE_DIM, rule_table

CLASSES = ["BENIGN", "Botnet", "DoS", "PortScan", "BruteForce"]
#: the class each stand-in model predicts, as SQL for both engines
RF_CLASS, LSTM_CLASS = (f"CASE (first_packet_id // {n}) % 5 {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(CLASSES))} END" for n in (3, 7))
CONF = "CAST(first_packet_id * {0} % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"

SIGNED_SQL = f"""{fq.FLOWS_SQL}, hits AS {HITS_SQL.split("hits AS ", 1)[1]}, {RULE_DIM},
member AS (SELECT flow_key || '@' || first_packet_id AS flow_id, packet_id FROM sessions),
firsts AS (SELECT flow_id, min(rule_order) AS rule_order FROM member JOIN hits USING (packet_id) GROUP BY 1),
signed AS (SELECT f.*, s.rule_order, d.rule_id, coalesce(d.kind, 'BENIGN') AS sig_type FROM flows f LEFT JOIN firsts s USING (flow_id) LEFT JOIN dim d ON d.rule_order = s.rule_order)"""
GATED_SQL = f"""{SIGNED_SQL}, raw AS (SELECT *, CASE WHEN rule_order IS NULL THEN 0 ELSE 1 END AS sig, {CONF.format(7919)} AS rf,
 CASE WHEN first_packet_id % 3 <> 0 THEN {CONF.format(104729)} ELSE 0 END AS lstm, {CONF.format(1299709)} AS ifo FROM signed),
sc AS (SELECT *, round(sig * 0.40e0 + rf * 0.35e0 + lstm * 0.15e0 + ifo * 0.10e0, 6) AS score FROM raw),
gated AS (SELECT first_packet_id AS event_id, flow_id, start_us AS t_us, src_ip, dst_ip, score,
 CASE WHEN sig = 1 THEN sig_type WHEN {RF_CLASS} <> 'BENIGN' THEN {RF_CLASS} WHEN {LSTM_CLASS} <> 'BENIGN' AND lstm > 0 THEN {LSTM_CLASS}
  WHEN ifo > 0.5 THEN 'ANOMALY' ELSE 'BENIGN' END AS attack_type,
 {vq.SEV.format("score")} AS severity FROM sc WHERE score >= 0.5e0)"""
MARKED = f"{GATED_SQL}, {vq.anchor_sql('gated', ['src_ip', 'dst_ip', 'attack_type'], vq.DEDUP, 'mk')}"
EMITTED = f"""{MARKED}, emitted AS (SELECT m.* EXCLUDE (anchor, opens), n - 1 AS dup_count FROM mk m
 JOIN (SELECT src_ip, dst_ip, attack_type, anchor, count(*) AS n FROM mk GROUP BY ALL) USING (src_ip, dst_ip, attack_type, anchor) WHERE opens)"""


def signed(spark, sf):
    return detection.signed_flows(ad.load(spark, sf, "packets"), rule_table(spark), fq.IDLE, fq.CHUNK)


@register("detect_flow_signatures", f"WITH {SIGNED_SQL} SELECT flow_id, rule_id, sig_type, rule_order IS NOT NULL AS matched FROM signed")
def flow_signatures(spark, sf):
    return signed(spark, sf).select("flow_id", "rule_id", "sig_type", "matched")


@register(
    "detect_alerts",
    f"""WITH RECURSIVE {EMITTED}, {vq.anchor_sql("emitted", ["src_ip"], vq.SHORT_GROUP, "grp")},
grouped AS (SELECT * EXCLUDE (anchor, opens), md5(src_ip || '|' || anchor) AS group_id, opens AS is_new_group FROM grp),
run AS (SELECT *, list_sort(list_distinct(list(attack_type) OVER w)) AS types FROM grouped
 WINDOW w AS (PARTITION BY group_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT md5(flow_id || '|' || CASE attack_type WHEN 'BENIGN' THEN 'ANOMALY' ELSE attack_type END || '|' || t_us) AS alert_id, flow_id, attack_type, severity,
 score AS confidence, group_id, is_new_group, len(types) >= 2 AS attack_chain, array_to_string(types, ',') AS types, dup_count FROM run""",
)
def detect_alerts(spark, sf):
    score = lambda p: F.expr(CONF.format(p))
    kind = lambda sql: F.expr(sql.replace("//", "div"))
    out = detection.detect(
        signed(spark, sf),
        (kind(RF_CLASS), score(7919), kind(RF_CLASS) != "BENIGN"),
        (kind(LSTM_CLASS), score(104729), kind(LSTM_CLASS) != "BENIGN"),
        (score(1299709) > 0.5, score(1299709)),
        F.expr("first_packet_id % 3 <> 0"), vq.DEDUP, vq.SHORT_GROUP,
    )
    return out.select(
        "alert_id", "flow_id", "attack_type", "severity", "confidence", "group_id", "is_new_group", "attack_chain",
        F.array_join("chain_attack_types", ",").alias("types"), "dup_count",
    )
