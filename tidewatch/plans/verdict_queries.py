"""Ensemble and correlation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import correlate, ensemble
from tidewatch.plans import adapters as ad
from tidewatch.plans.catalog import register

HOUR = 3600 * 1_000_000
DEDUP, GROUP, SHORT_GROUP = 12 * HOUR, 72 * HOUR, 6 * HOUR


def engines(spark, sf):
    s = ad.load(spark, sf, "scores")
    sig = s.filter("sig_conf > 0").selectExpr(
        "flow_id", "TRUE AS matched", "'R1' AS rule_id", "attack_type", "sig_conf AS confidence"
    )
    rf = s.filter("event_id % 6 <> 0").selectExpr(
        "flow_id", "CASE WHEN rf_conf > 0.3 THEN attack_type ELSE 'BENIGN' END AS predicted_class",
        "rf_conf AS confidence", "rf_conf > 0.3 AS is_attack",
    )
    lstm = s.filter("event_id % 5 <> 0").selectExpr(
        "flow_id", "CASE WHEN event_id % 2 = 0 THEN 'Botnet' ELSE 'BENIGN' END AS predicted_class",
        "lstm_conf AS confidence", "event_id % 2 = 0 AS is_attack", "event_id % 3 <> 0 AS window_complete",
    )
    iforest = s.filter("event_id % 7 <> 0").selectExpr(
        "flow_id", "if_conf > 0.5 AS is_anomaly", "if_conf AS confidence"
    )
    base = s.select("flow_id", "event_id", "t_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    return base, sig, rf, lstm, iforest


COMBINED_SQL = f"""{ad.cte("scores")},
combined AS (SELECT flow_id, event_id, t_us, src_ip, dst_ip, src_port, dst_port, protocol,
 sig_conf > 0 AS sig_matched, CASE WHEN sig_conf > 0 THEN attack_type ELSE 'BENIGN' END AS sig_type, sig_conf,
 CASE WHEN event_id % 6 <> 0 AND rf_conf > 0.3e0 THEN attack_type ELSE 'BENIGN' END AS rf_type,
 CASE WHEN event_id % 6 <> 0 THEN rf_conf ELSE 0 END AS rf_conf, event_id % 6 <> 0 AND rf_conf > 0.3e0 AS rf_attack,
 CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 'Botnet' ELSE 'BENIGN' END AS lstm_type,
 CASE WHEN event_id % 5 <> 0 THEN lstm_conf ELSE 0 END AS lstm_conf, event_id % 5 <> 0 AND event_id % 2 = 0 AS lstm_attack,
 event_id % 5 <> 0 AND event_id % 3 <> 0 AS window_complete,
 event_id % 7 <> 0 AND if_conf > 0.5e0 AS is_anomaly, CASE WHEN event_id % 7 <> 0 THEN if_conf ELSE 0 END AS if_conf FROM scores)"""
SCORE = "round(least(greatest(sig_conf * 0.40e0 + rf_conf * 0.35e0 + lstm_conf * 0.15e0 + if_conf * 0.10e0, 0), 1), 6)"
SEV = "CASE WHEN {0} >= 0.95e0 THEN 'CRITICAL' WHEN {0} >= 0.85e0 THEN 'HIGH' WHEN {0} >= 0.70e0 THEN 'MEDIUM' ELSE 'LOW' END"
VERDICTS_SQL = f"""{COMBINED_SQL},
warm AS (SELECT * REPLACE (CASE WHEN window_complete THEN lstm_conf ELSE 0 END AS lstm_conf) FROM combined),
scored AS (SELECT *, {SCORE} AS score, lstm_conf > 0 AND lstm_attack AS lstm_hit FROM warm),
eng AS (SELECT *, [x FOR x IN [CASE WHEN sig_matched THEN 'signature' END, CASE WHEN rf_attack THEN 'rf' END,
 CASE WHEN lstm_hit THEN 'lstm' END, CASE WHEN is_anomaly THEN 'isolation_forest' END] IF x IS NOT NULL] AS contributing_engines FROM scored),
verdicts AS (SELECT *, score >= 0.5e0 AS alert, CASE WHEN score >= 0.5e0 THEN {SEV.format("score")} ELSE 'NONE' END AS severity,
 CASE WHEN sig_matched THEN sig_type WHEN rf_attack THEN rf_type WHEN lstm_hit THEN lstm_type WHEN is_anomaly THEN 'ANOMALY' ELSE 'BENIGN' END AS attack_type,
 CASE WHEN len(contributing_engines) = 0 THEN 'none' WHEN sig_matched AND len(contributing_engines) > 1 THEN 'both'
  WHEN sig_matched THEN 'signature' ELSE 'ml' END AS detected_by FROM eng)"""


@register("ens_combine", f"WITH {COMBINED_SQL} SELECT * FROM combined")
def combine(spark, sf):
    return ensemble.combine(*engines(spark, sf)).drop("rule_id")


def verdicts(spark, sf):
    return ensemble.verdicts(ensemble.combine(*engines(spark, sf)))


@register(
    "ens_verdicts",
    f"WITH {VERDICTS_SQL} SELECT flow_id, score, alert, severity, attack_type, array_to_string(contributing_engines, ',') AS engines, detected_by, lstm_conf FROM verdicts",
)
def ens_verdicts(spark, sf):
    return verdicts(spark, sf).select(
        "flow_id", "score", "alert", "severity", "attack_type",
        F.array_join("contributing_engines", ",").alias("engines"), "detected_by", "lstm_conf",
    )


@register(
    "ens_severity_counts",
    f"WITH {VERDICTS_SQL} SELECT severity, count(*) AS n FROM verdicts GROUP BY 1",
)
def severity_counts(spark, sf):
    return verdicts(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "ens_connector_variant",
    f"""WITH {ad.cte("scores")}, n AS (SELECT flow_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE sig_conf END AS s, CASE WHEN event_id % 4 = 1 THEN 0 ELSE rf_conf END AS r,
 lstm_conf AS l, CASE WHEN event_id % 5 = 2 THEN 0 ELSE if_conf END AS i, attack_type AS st, CASE WHEN event_id % 2 = 0 THEN attack_type ELSE 'BENIGN' END AS rt,
 CASE WHEN event_id % 6 = 0 THEN 'Botnet' ELSE 'BENIGN' END AS lt FROM scores),
o AS (SELECT *, s * 0.40e0 + r * 0.35e0 + l * 0.15e0 + i * 0.10e0 AS x, s > 0 AND st <> 'BENIGN' AS so, r > 0 AND rt <> 'BENIGN' AS ro, l > 0 AND lt <> 'BENIGN' AS lo, i > 0 AS io FROM n)
SELECT flow_id, round(x + 1e-9, 4) AS ensemble_score, CASE WHEN so THEN st WHEN ro THEN rt WHEN lo THEN lt WHEN io THEN 'ANOMALY' ELSE 'UNKNOWN' END AS attack_type,
 CASE WHEN NOT (so OR ro OR lo OR io) THEN 'ml' WHEN so AND (ro OR lo OR io) THEN 'both' WHEN so THEN 'signature' WHEN ro THEN 'rf' WHEN lo THEN 'lstm' ELSE 'if' END AS detected_by,
 {SEV.format("round(x, 6)")} AS severity FROM o""",
)
def connector_variant(spark, sf):
    s = ad.load(spark, sf, "scores").selectExpr(
        "flow_id", "CASE WHEN event_id % 3 <> 0 THEN sig_conf END AS sig_conf",
        "CASE WHEN event_id % 4 <> 1 THEN rf_conf END AS rf_conf", "lstm_conf",
        "CASE WHEN event_id % 5 <> 2 THEN if_conf END AS if_conf", "attack_type AS sig_type",
        "CASE WHEN event_id % 2 = 0 THEN attack_type END AS rf_type",
        "CASE WHEN event_id % 6 = 0 THEN 'Botnet' END AS lstm_type",
    )
    return ensemble.connector_verdicts(s).select("flow_id", "ensemble_score", "attack_type", "detected_by", "severity")


@register(
    "ens_method_variant",
    f"""WITH {ad.cte("scores")}, x AS (SELECT *, round(sig_conf * 0.40e0 + rf_conf * 0.35e0 + lstm_conf * 0.15e0 + if_conf * 0.10e0, 6) AS e FROM scores)
SELECT flow_id, e AS ensemble_score, CASE WHEN sig_conf > 0 THEN 'HYBRID' ELSE 'ENSEMBLE' END AS detection_method,
 CASE WHEN sig_conf > 0 THEN attack_type ELSE 'Botnet' END AS attack_type FROM x WHERE e >= 0.5e0""",
)
def method_variant(spark, sf):
    s = ad.load(spark, sf, "scores").selectExpr(
        "flow_id", "sig_conf", "rf_conf", "lstm_conf", "if_conf", "sig_conf > 0 AS sig_matched",
        "CASE WHEN sig_conf > 0 THEN attack_type ELSE 'BENIGN' END AS sig_type", "'Botnet' AS rf_type",
    )
    return ensemble.method_verdicts(s).select("flow_id", "ensemble_score", "detection_method", "attack_type")


@register(
    "ens_ml_partial",
    f"""WITH {ad.cte("scores")} SELECT flow_id, round(rf_conf * 0.35e0 + CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0 ELSE lstm_conf END * 0.15e0 + if_conf * 0.10e0, 6) AS ml_score,
 CASE WHEN rf_conf > 0.6e0 THEN attack_type WHEN lstm_conf > 0.5e0 AND event_id % 3 <> 0 THEN 'DDoS' WHEN if_conf > 0.5e0 THEN 'ANOMALY' ELSE 'BENIGN' END AS ml_type FROM scores""",
)
def ml_partial(spark, sf):
    s = ad.load(spark, sf, "scores").selectExpr(
        "flow_id", "rf_conf", "lstm_conf", "if_conf", "event_id % 3 = 0 AS cold_start", "event_id % 5 = 0 AS timed_out",
        "rf_conf > 0.6 AS rf_attack", "attack_type AS rf_type", "lstm_conf > 0.5 AS lstm_attack", "'DDoS' AS lstm_type",
        "if_conf > 0.5 AS is_anomaly",
    )
    return ensemble.ml_partial(s).select("flow_id", "ml_score", "ml_type")


# --- correlation -----------------------------------------------------------


def gated(spark, sf):
    return verdicts(spark, sf).filter("alert").select(
        "event_id", "flow_id", "t_us", "src_ip", "dst_ip", "attack_type", "severity", "score"
    )


def anchor_sql(source, keys, width, out):
    """Anchored windows of ``source`` as a recursive walk over row numbers."""
    part = ", ".join(keys)
    same = " AND ".join(f"o.{k} = f.{k}" for k in keys)
    cols = ", ".join(f"o.{k}" for k in keys)
    return f"""{out}_o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY t_us, event_id) AS rn FROM {source}),
{out}_f AS (SELECT {part}, rn, event_id, t_us AS anchor, TRUE AS opens FROM {out}_o WHERE rn = 1 UNION ALL
 SELECT {cols}, o.rn, o.event_id, CASE WHEN o.t_us > f.anchor + {width}::BIGINT THEN o.t_us ELSE f.anchor END, o.t_us > f.anchor + {width}::BIGINT
 FROM {out}_f f JOIN {out}_o o ON {same} AND o.rn = f.rn + 1),
{out} AS (SELECT s.*, f.anchor, f.opens FROM {source} s JOIN {out}_f f USING (event_id))"""


GATED_SQL = f"{VERDICTS_SQL}, gated AS (SELECT event_id, flow_id, t_us, src_ip, dst_ip, attack_type, severity, score FROM verdicts WHERE alert)"
MARKED_SQL = f"{GATED_SQL}, {anchor_sql('gated', correlate.DEDUP_KEY, DEDUP, 'marked')}"
EMITTED_SQL = f"""{MARKED_SQL}, emitted AS (SELECT m.* EXCLUDE (anchor, opens), n - 1 AS dup_count FROM marked m
 JOIN (SELECT src_ip, dst_ip, attack_type, anchor, count(*) AS n FROM marked GROUP BY ALL) USING (src_ip, dst_ip, attack_type, anchor) WHERE opens)"""


def grouped_sql(width):
    return f"""{EMITTED_SQL}, {anchor_sql('emitted', ['src_ip'], width, 'grp')},
grouped AS (SELECT * EXCLUDE (anchor, opens), md5(src_ip || '|' || anchor) AS group_id, anchor AS group_start_us, opens AS is_new_group,
 CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank FROM grp)"""


@register("cor_suppressions", f"WITH RECURSIVE {MARKED_SQL} SELECT event_id, anchor, opens FROM marked")
def suppressions(spark, sf):
    return correlate.suppressions(gated(spark, sf), DEDUP).select("event_id", "anchor", "opens")


@register("cor_dedup", f"WITH RECURSIVE {EMITTED_SQL} SELECT event_id, src_ip, dst_ip, attack_type, t_us, dup_count FROM emitted")
def dedup(spark, sf):
    return correlate.deduplicate(gated(spark, sf), DEDUP).select("event_id", "src_ip", "dst_ip", "attack_type", "t_us", "dup_count")


def chain_sql(width):
    return f"""WITH RECURSIVE {grouped_sql(width)}, run AS (SELECT *, max(rank) OVER w AS top, list_sort(list_distinct(list(attack_type) OVER w)) AS types
 FROM grouped WINDOW w AS (PARTITION BY group_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, group_id, is_new_group, dup_count, array_to_string(types, ',') AS types, len(types) >= 2 AS attack_chain,
 ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][top] AS composite_severity FROM run"""


def _chain_view(df):
    return df.select(
        "event_id", "group_id", "is_new_group", "dup_count", F.array_join("chain_attack_types", ",").alias("types"),
        "attack_chain", "composite_severity",
    )


@register("cor_chains", chain_sql(GROUP))
def chains(spark, sf):
    return _chain_view(correlate.correlate(gated(spark, sf), DEDUP, GROUP))


@register("cor_chains_short", chain_sql(SHORT_GROUP))
def chains_short(spark, sf):
    return _chain_view(correlate.correlate(gated(spark, sf), DEDUP, SHORT_GROUP))


@register(
    "cor_groups",
    f"""WITH RECURSIVE {grouped_sql(SHORT_GROUP)} SELECT group_id, src_ip, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(rank)] AS composite_severity,
 count(*) AS members, array_to_string(list_sort(list_distinct(list(attack_type))), ',') AS types, min(t_us) AS first_seen_us, max(t_us) AS last_seen_us,
 count(DISTINCT attack_type) >= 2 AS attack_chain FROM grouped GROUP BY group_id, src_ip""",
)
def groups(spark, sf):
    g = correlate.group(correlate.deduplicate(gated(spark, sf), DEDUP), SHORT_GROUP)
    return correlate.group_summary(g).withColumn("types", F.array_join("attack_types", ",")).drop("attack_types")


AT = 1706486400000000  # 2024-01-29


@register(
    "cor_counters",
    f"""WITH RECURSIVE {grouped_sql(SHORT_GROUP)}, g AS (SELECT group_id, min(group_start_us) AS g, count(DISTINCT attack_type) AS k FROM grouped GROUP BY 1)
SELECT count(*) AS total_received, count(*) FILTER (NOT opens) AS total_suppressed, count(*) FILTER (opens) AS total_emitted,
 count(*) FILTER (opens AND anchor <= {AT}::BIGINT AND {AT}::BIGINT - anchor <= {DEDUP}::BIGINT) AS active_dedup_slots,
 count(*) FILTER (opens AND {AT}::BIGINT - anchor > {DEDUP}::BIGINT) AS evicted_dedup,
 (SELECT count(*) FROM g WHERE k > 1) AS chain_flags_raised,
 (SELECT count(*) FROM g WHERE g <= {AT}::BIGINT AND {AT}::BIGINT - g <= {SHORT_GROUP}::BIGINT) AS active_correlation_groups,
 (SELECT count(*) FROM g WHERE {AT}::BIGINT - g > {SHORT_GROUP}::BIGINT) AS evicted_groups FROM marked""",
)
def counters(spark, sf):
    e = gated(spark, sf)
    g = correlate.group(correlate.deduplicate(e, DEDUP), SHORT_GROUP)
    return correlate.counters(correlate.suppressions(e, DEDUP), g, AT, DEDUP, SHORT_GROUP)


def _lag_sql(key):
    return f"""SELECT *, lag(alert_id) OVER w AS pid, lag(t_us) OVER w AS pt, lag(src_ip) OVER w AS ps, lag(dst_ip) OVER w AS pd, lag(attack_type) OVER w AS pa
 FROM alerts WINDOW w AS (PARTITION BY {key} ORDER BY t_us, alert_id)"""


@register(
    "cor_links",
    f"""WITH {ad.cte("alerts")}, s AS ({_lag_sql("src_ip")}), d AS ({_lag_sql("dst_ip")})
SELECT alert_id, pid AS related_id, CASE WHEN attack_type <> pa THEN 'MULTI_STAGE' WHEN dst_ip = pd THEN 'TEMPORAL_SEQUENCE' ELSE 'SAME_SOURCE' END AS relation FROM s WHERE t_us - pt <= {HOUR}::BIGINT
UNION ALL SELECT alert_id, pid, 'SAME_TARGET' FROM d WHERE t_us - pt <= {HOUR}::BIGINT AND ps <> src_ip""",
)
def links(spark, sf):
    return correlate.links(ad.load(spark, sf, "alerts"), HOUR, 24 * HOUR)


@register(
    "cor_coordinated",
    f"""WITH {ad.cte("alerts")} SELECT dst_ip, attack_type, t_us // {HOUR}::BIGINT * {HOUR}::BIGINT AS window_us, count(DISTINCT src_ip) AS sources, count(*) AS events
FROM alerts GROUP BY ALL HAVING count(DISTINCT src_ip) >= 2""",
)
def coordinated(spark, sf):
    return correlate.coordinated(ad.load(spark, sf, "alerts"), HOUR, 2)
