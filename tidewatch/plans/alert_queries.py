"""Alert records and workflow: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import alerts
from tidewatch.plans import adapters as ad
from tidewatch.plans.catalog import register

A = ad.cte("alerts")
NOW = 1706659200000000  # 2024-01-31


def load(spark, sf):
    return ad.load(spark, sf, "alerts")


def _case(values, key, default):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {whens} ELSE '{default}' END"


SEV = "CASE WHEN confidence >= 0.95e0 THEN 'CRITICAL' WHEN confidence >= 0.85e0 THEN 'HIGH' WHEN confidence >= 0.7e0 THEN 'MEDIUM' ELSE 'LOW' END"


@register(
    "alr_build",
    f"""WITH {A}, e AS (SELECT flow_id, confidence, t_us, CASE WHEN event_id % 6 = 1 THEN 'ANOMALY' WHEN event_id % 19 = 0 THEN 'Odd' ELSE attack_type END AS attack_type FROM alerts)
SELECT md5(flow_id || '|' || attack_type || '|' || t_us) AS alert_id, flow_id, attack_type, {SEV} AS severity,
 {_case(alerts.DESCRIPTIONS, "attack_type", alerts.DEFAULT_DESCRIPTION)} AS description,
 {_case(alerts.RECOMMENDED_ACTIONS, "attack_type", alerts.DEFAULT_ACTION)} AS recommended_action, 'open' AS status FROM e""",
)
def build(spark, sf):
    kind = F.expr("CASE WHEN event_id % 6 = 1 THEN 'BENIGN' WHEN event_id % 19 = 0 THEN 'Odd' ELSE attack_type END")
    e = load(spark, sf).select("flow_id", "confidence", "t_us", kind.alias("attack_type"))
    return alerts.build_alerts(e).select(
        "alert_id", "flow_id", "attack_type", "severity", "description", "recommended_action", "status"
    )


@register(
    "alr_descriptions",
    f"""WITH {A}, p AS (SELECT *, coalesce(src_port::VARCHAR, '*') AS sp, coalesce(dst_port::VARCHAR, '*') AS dp, coalesce(protocol, 'unknown') AS pr FROM alerts)
SELECT alert_id, severity || ' severity ' || attack_type || ' detected from ' || src_ip || ':' || sp || ' → ' || dst_ip || ':' || dp || ' via ' || pr || printf(' (confidence=%.3f, engine=%s)', confidence, detected_by) AS ingest_text,
 severity || ' severity ' || attack_type || ' detected. Source: ' || src_ip || ':' || sp || ' → Destination: ' || dst_ip || ':' || dp || ' via ' || pr || printf('. Ensemble confidence: %.3f. Detected by: %s.', confidence, detected_by) AS connector_text,
 CASE detected_by WHEN 'signature' THEN 'Signature rule match' WHEN 'ml' THEN 'ML ensemble detection' ELSE 'Signature + ML corroboration' END || ': ' || attack_type || ' detected from ' || src_ip || ' → ' || dst_ip || ':' || coalesce(dst_port::VARCHAR, '?') || ' (confidence ' || printf('%.2f', confidence_c) || ')' AS service_text
FROM (SELECT *, floor(confidence * 100 + 1e-9) / 100 AS confidence_c FROM p)""",
)
def descriptions(spark, sf):
    a = load(spark, sf)
    full = alerts.described(a).select("alert_id", "ingest_text", "connector_text")
    cents = alerts.described(a.withColumn("confidence", F.floor(F.col("confidence") * 100 + 1e-9) / 100))
    return full.join(cents.select("alert_id", "service_text"), "alert_id")


@register(
    "alr_midpoint",
    f"WITH {A} SELECT alert_id, CASE severity WHEN 'CRITICAL' THEN 0.97e0 WHEN 'HIGH' THEN 0.9e0 WHEN 'MEDIUM' THEN 0.75e0 ELSE 0.55e0 END AS midpoint FROM alerts",
)
def midpoint(spark, sf):
    return load(spark, sf).select("alert_id", alerts.midpoint(F.lower("severity")).alias("midpoint"))


_DIRTY = [
    "alert_id", "CASE WHEN event_id % 20 = 1 THEN NULL ELSE attack_type END AS attack_type",
    "CASE WHEN event_id % 20 = 2 THEN 'URGENT' ELSE lower(severity) END AS severity",
    "CASE WHEN event_id % 20 = 3 THEN 15e-1 WHEN event_id % 20 = 4 THEN NULL ELSE confidence END AS confidence",
    "CASE WHEN event_id % 20 = 5 THEN 'other' ELSE upper(detected_by) END AS detected_by", "src_ip", "dst_ip",
    "CASE WHEN event_id % 20 = 6 THEN 70000 ELSE src_port END AS src_port", "dst_port",
    "CASE WHEN event_id % 20 = 7 THEN 'TOOLONGNAME' ELSE protocol END AS protocol", "description",
]


@register(
    "alr_validate",
    f"""WITH {A}, d AS (SELECT {", ".join(_DIRTY)} FROM alerts) SELECT alert_id, upper(severity) AS severity, lower(detected_by) AS detected_by,
 CASE WHEN attack_type IS NULL THEN 'missing_field' WHEN length(protocol) > 8 THEN 'too_long' WHEN severity = 'URGENT' THEN 'bad_severity'
 WHEN detected_by = 'other' THEN 'bad_detected_by' WHEN confidence IS NULL OR confidence > 1 THEN 'bad_confidence' WHEN src_port > 65535 THEN 'bad_port' END AS reject_reason FROM d""",
)
def validate(spark, sf):
    return alerts.validated(load(spark, sf).selectExpr(*_DIRTY)).select("alert_id", "severity", "detected_by", "reject_reason")


@register(
    "alr_page",
    f"WITH {A} SELECT alert_id, t_us, severity, status FROM alerts WHERE severity = 'LOW' AND status = 'open' ORDER BY t_us DESC, alert_id LIMIT 20 OFFSET 40",
)
def page(spark, sf):
    hit = alerts.filtered(load(spark, sf), severity="low", status="OPEN")
    return alerts.page(hit, 3, 20).select("alert_id", "t_us", "severity", "status")


@register(
    "alr_filter_total",
    f"WITH {A} SELECT count(*) AS total FROM alerts WHERE src_ip = '10.0.0.3' AND attack_type = 'DoS' AND t_us >= 1704500000000000 AND t_us <= 1706000000000000",
)
def filter_total(spark, sf):
    hit = alerts.filtered(
        load(spark, sf), src_ip="10.0.0.3", attack_type="DoS", from_us=1704500000000000, to_us=1706000000000000
    )
    return hit.agg(F.count(F.lit(1)).alias("total"))


@register("alr_lookup", f"WITH {A} SELECT alert_id, severity, attack_type, src_ip FROM alerts WHERE alert_id = 'a77'")
def lookup(spark, sf):
    return alerts.lookup(load(spark, sf), "a77").select("alert_id", "severity", "attack_type", "src_ip")


@register(
    "alr_search",
    f"WITH {A} SELECT alert_id FROM alerts WHERE contains(lower(concat_ws(' ', alert_id, attack_type, src_ip, dst_ip, detected_by)), 'botnet 10.0.0.1') AND severity = 'MEDIUM'",
)
def search(spark, sf):
    return alerts.search(load(spark, sf), "Botnet 10.0.0.1", severity="MEDIUM").select("alert_id")


@register("alr_sorted", f"WITH {A} SELECT alert_id, confidence FROM alerts ORDER BY confidence DESC, alert_id")
def sorted_by(spark, sf):
    return alerts.sorted_by(load(spark, sf), "confidence", True).select("alert_id", "confidence")


@register("alr_status_counts", f"WITH {A} SELECT status, count(*) AS n FROM alerts GROUP BY 1")
def status_counts(spark, sf):
    return alerts.status_counts(load(spark, sf))


@register(
    "alr_live_feed",
    f"""WITH {A}, t AS (SELECT alert_id, t_us, attack_type, severity FROM alerts ORDER BY t_us DESC, alert_id LIMIT 80)
SELECT *, (SELECT round(count(*) FILTER (severity <> 'LOW') * 100.0 / count(*), 1)::DOUBLE FROM t) AS alert_rate FROM t""",
)
def live_feed(spark, sf):
    a = load(spark, sf)
    return alerts.live_feed(a.unionByName(a))


@register(
    "alr_parse_notes",
    f"""WITH {A}, l AS (SELECT alert_id, unnest(string_split(description, chr(10))) AS line FROM alerts),
b AS (SELECT alert_id, trim(substr(line, 7)) AS body FROM l WHERE starts_with(line, '[Note]'))
SELECT alert_id, regexp_extract(body, '^([0-9T:.-]+)Z ', 1) AS ts, CASE WHEN regexp_matches(body, '^[0-9TZ:.-]+ ') THEN regexp_replace(body, '^[0-9TZ:.-]+ +', '') ELSE body END AS text FROM b WHERE body <> ''""",
)
def parse_notes(spark, sf):
    n = load(spark, sf).select("alert_id", F.explode(alerts.parse_notes(F.col("description"))).alias("n"))
    ts = F.coalesce(F.date_format(F.col("n.ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return n.select("alert_id", ts.alias("ts"), F.col("n.text").alias("text"))


@register(
    "alr_append_notes",
    f"""WITH {A}, {ad.cte("actions")}, n AS (SELECT alert_id, string_agg('[Note] ' || strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || trim(note), chr(10) ORDER BY t_us, action_id) AS added
 FROM actions WHERE trim(note) <> '' GROUP BY 1)
SELECT alert_id, concat_ws(chr(10), description, added) AS description FROM alerts LEFT JOIN n USING (alert_id)""",
)
def append_notes(spark, sf):
    return alerts.append_notes(load(spark, sf), ad.load(spark, sf, "actions")).select("alert_id", "description")


LEGAL = "(action <> 'resolve' OR (resolution_type IN ('true_positive', 'false_positive', 'benign', 'duplicate') AND coalesce(trim(note), '') <> ''))"


def _next(state):
    return f"""CASE WHEN NOT {LEGAL} THEN {state} WHEN action = 'acknowledge' AND {state} = 'open' THEN 'acknowledged'
 WHEN action = 'escalate' AND {state} IN ('open', 'acknowledged') THEN 'escalated' WHEN action = 'false_positive' AND {state} IN ('open', 'acknowledged') THEN 'false_positive'
 WHEN action = 'resolve' AND {state} IN ('acknowledged', 'escalated', 'false_positive') THEN 'resolved' WHEN action = 'reopen' AND {state} IN ('resolved', 'false_positive') THEN 'open' ELSE {state} END"""


APPLIED_SQL = f"""{ad.cte("actions")}, o AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY t_us, action_id) AS rn FROM actions),
f AS (SELECT o.*, 'open' AS previous_status, {_next("'open'")} AS new_status FROM o WHERE rn = 1 UNION ALL
 SELECT o.*, f.new_status, {_next("f.new_status").replace("action", "o.action").replace("o.o.", "o.").replace("resolution_type", "o.resolution_type").replace("note", "o.note")} FROM f JOIN o ON o.alert_id = f.alert_id AND o.rn = f.rn + 1),
applied AS (SELECT *, previous_status <> new_status AS accepted FROM f)"""


def applied(spark, sf):
    return alerts.apply_actions(ad.load(spark, sf, "actions"))


@register("alr_workflow", f"WITH RECURSIVE {APPLIED_SQL} SELECT action_id, alert_id, previous_status, accepted, new_status FROM applied")
def workflow(spark, sf):
    return applied(spark, sf).select("action_id", "alert_id", "previous_status", "accepted", "new_status")


def _last(value, cond):
    return f"last({value} ORDER BY t_us, action_id) FILTER ({cond})"


@register(
    "alr_workflow_state",
    f"""WITH RECURSIVE {APPLIED_SQL}, ok AS (SELECT *, CASE WHEN action = 'false_positive' THEN 'false_positive' ELSE resolution_type END AS rk,
 CASE WHEN action = 'false_positive' THEN coalesce(nullif(note, ''), '{alerts.FALSE_POSITIVE_NOTE}') ELSE trim(note) END AS rn2 FROM applied WHERE accepted)
SELECT alert_id, last(new_status ORDER BY t_us, action_id) AS status, {_last("performed_by", "action = 'acknowledge'")} AS acknowledged_by,
 {_last("t_us", "action = 'acknowledge'")} AS acknowledged_us, {_last("performed_by", "action = 'escalate'")} AS escalated_by, {_last("t_us", "action = 'escalate'")} AS escalated_us,
 {_last("performed_by", "action IN ('false_positive', 'resolve')")} AS resolved_by, {_last("t_us", "action IN ('false_positive', 'resolve')")} AS resolved_us,
 {_last("rk", "action IN ('false_positive', 'resolve')")} AS resolution_type, {_last("rn2", "action IN ('false_positive', 'resolve')")} AS resolution_note, count(*) AS accepted_actions
FROM ok GROUP BY alert_id""",
)
def workflow_state(spark, sf):
    return alerts.workflow_state(applied(spark, sf))


@register(
    "alr_audit_rows",
    f"""WITH RECURSIVE {APPLIED_SQL} SELECT md5(alert_id || '|' || action_id) AS id, performed_by AS user_id, 'ALERT_' || upper(action) AS action, 'alert' AS entity_type, alert_id AS entity_id,
 CASE WHEN action = 'resolve' THEN '{{"previous_status":"' || previous_status || '","resolution_type":"' || resolution_type || '","resolution_note":"' || note || '"}}'
 ELSE '{{"previous_status":"' || previous_status || '","note":' || coalesce('"' || note || '"', 'null') || '}}' END AS detail, t_us AS created_us FROM applied WHERE accepted""",
)
def audit_rows(spark, sf):
    return alerts.audit_rows(applied(spark, sf))


@register(
    "alr_status_events",
    f"""WITH RECURSIVE {APPLIED_SQL}, {A} SELECT action_id, a.alert_id, new_status, coalesce(severity, 'UNKNOWN') AS severity, performed_by
FROM applied a LEFT JOIN alerts USING (alert_id) WHERE accepted""",
)
def status_events(spark, sf):
    e = alerts.status_events(applied(spark, sf), load(spark, sf))
    j = F.from_json("payload", "event string, alert_id string, new_status string, severity string, performed_by string")
    return e.select("action_id", j.alias("j")).filter("j.event = 'alert.status_changed'").select(
        "action_id", "j.alert_id", "j.new_status", "j.severity", "j.performed_by"
    )


@register(
    "alr_new_alert_events",
    f"WITH {A} SELECT alert_id, severity, attack_type, src_ip, round(confidence, 4) AS confidence, attack_chain, status FROM alerts",
)
def new_alert_events(spark, sf):
    e = alerts.new_alert_events(load(spark, sf))
    j = F.from_json(
        "payload", "severity string, attack_type string, src_ip string, confidence double, attack_chain boolean, status string"
    )
    return e.select("alert_id", j.alias("j")).select("alert_id", "j.*")


@register(
    "alr_notifications",
    f"""WITH {A} SELECT alert_id, CASE WHEN status = 'escalated' THEN '[ESCALATED] ' ELSE '' END || 'Security ' || severity || ' Alert: ' || attack_type || ' from ' || src_ip
 || CASE WHEN attack_chain THEN ' ⚠ ATTACK CHAIN' ELSE '' END AS subject,
 'Alert ID     : ' || alert_id || chr(10) || 'Severity     : ' || severity || chr(10) || 'Attack Type  : ' || attack_type || chr(10) || 'Source IP    : ' || src_ip || chr(10)
 || 'Destination  : ' || dst_ip || chr(10) || 'Confidence   : ' || printf('%.1f', confidence * 100 + 1e-9) || '%' || chr(10) || 'Detected by  : ' || detected_by AS body
FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')""",
)
def notifications(spark, sf):
    return alerts.notifications(load(spark, sf))


@register(
    "alr_visibility",
    f"""WITH {A}, r(role) AS (VALUES ('system_admin'), ('soc_manager'), ('network_admin'), ('read_only_analyst'))
SELECT role, severity, count(*) AS n FROM alerts, r WHERE role <> 'read_only_analyst' OR severity IN ('MEDIUM', 'LOW') GROUP BY ALL""",
)
def visibility(spark, sf):
    return alerts.visibility(load(spark, sf)).groupBy("role", "severity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "alr_time_labels",
    f"""WITH {A}, s AS (SELECT alert_id, t_us, ({NOW}::BIGINT - t_us) / 1e6 AS sec FROM (SELECT alert_id, CASE WHEN event_id % 4 = 0 THEN {NOW}::BIGINT - event_id * 700000 ELSE t_us END AS t_us FROM alerts))
SELECT alert_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN sec < 10 THEN 'just now' WHEN sec < 60 THEN floor(sec)::BIGINT || 's ago'
 WHEN sec < 3600 THEN floor(sec / 60)::BIGINT || 'm ago' ELSE floor(sec / 3600)::BIGINT || 'h ago' END AS age FROM s""",
)
def time_labels(spark, sf):
    t = F.expr(f"CASE WHEN event_id % 4 = 0 THEN {NOW}L - event_id * 700000 ELSE t_us END")
    a = load(spark, sf).select("alert_id", t.alias("t_us"))
    return a.select("alert_id", alerts.iso_time(F.col("t_us")).alias("iso"), alerts.age_label(F.col("t_us"), NOW).alias("age"))
