"""Report queries over the given tables and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.plans import adapters as ad
from tidewatch.plans import reports as rp
from tidewatch.plans.catalog import r, register, rounded
from tidewatch.session import scratch_path
from tidewatch.sources import tables

START, END = rp.period(datetime(2024, 1, 31), start_date="2024-01-05", end_date="2024-01-24")
NOW = rp.micros(datetime(2024, 1, 31))
LATE = rp.micros(datetime(2024, 1, 30, 12, 30))

A = f"{ad.cte('alerts')}, a AS (SELECT * FROM alerts WHERE t_us BETWEEN {START} AND {END})"
W = ad.cte("audit")
SEV_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in rp.SEVERITIES)


def alerts(spark, sf):
    return rp.in_period(ad.load(spark, sf, "alerts"), START, END)


def audit(spark, sf):
    return ad.load(spark, sf, "audit")


def one(name, fn, sql):
    register(name, sql)(lambda spark, sf: fn(alerts(spark, sf)))


one("rpt_severity", rp.severity_breakdown, f"WITH {A} SELECT {SEV_COUNTS}, count(*) AS total FROM a")
TYPES_SQL = "t AS (SELECT attack_type, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, attack_type LIMIT {})"
one(
    "rpt_attack_types", lambda a: rp.top_attack_types(a, 3),
    f"WITH {A}, {TYPES_SQL.format(3)} SELECT attack_type, n, {r('n * 100 / sum(n) OVER ()', 'percentage', 1)} FROM t",
)
SOURCES_SQL = """src AS (SELECT src_ip, attack_type, count(*) AS c, min(t_us) AS lo, max(t_us) AS hi FROM a GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY c DESC, attack_type) AS rn FROM src),
sources AS (SELECT src_ip, sum(c)::BIGINT AS n, min(attack_type) FILTER (rn = 1) AS top_attack, min(lo) AS first_seen_us, max(hi) AS last_seen_us
 FROM best GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 10)"""
one("rpt_sources", rp.top_sources, f"WITH {A}, {SOURCES_SQL} SELECT * FROM sources")
DAYS = f"days AS (SELECT strftime(make_timestamp(t_us), '%Y-%m-%d') AS day, {SEV_COUNTS} FROM a GROUP BY 1)"
one("rpt_timeline", rp.daily_timeline, f"WITH {A}, {DAYS} SELECT * FROM days")
ENGINES = f"""eng AS (SELECT count(*) FILTER (detected_by = 'signature') AS signature_triggered, count(*) FILTER (detected_by = 'ml') AS ml_triggered,
 count(*) FILTER (detected_by = 'both') AS both_triggered, count(*) FILTER (status = 'false_positive') AS false_positive_count FROM a)"""
FPR = r("false_positive_count / (signature_triggered + ml_triggered + both_triggered)", "false_positive_rate")
one("rpt_engines", rp.engine_stats, f"WITH {A}, {ENGINES} SELECT *, {FPR} FROM eng")
one("rpt_confidence", rp.average_confidence, f"WITH {A} SELECT {r('avg(confidence)', 'average_confidence')} FROM a")
one(
    "rpt_peak_hour", rp.peak_hour,
    f"WITH {A} SELECT hour(make_timestamp(t_us))::INT AS peak_hour, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1",
)
RESOLVED = r("count(*) FILTER (status IN ('acknowledged', 'false_positive')) / count(*)", "resolution_rate")
one("rpt_resolution", rp.resolution_rate, f"WITH {A} SELECT {RESOLVED} FROM a")
COMPLIANCE = f"""comp AS (SELECT (SELECT count(*) FROM audit) AS audit_entries, count(*) FILTER (status = 'acknowledged') AS acknowledged_alerts,
 count(*) FILTER (status = 'open') AS unacknowledged_alerts, {r("avg((ack_us - t_us) / 60e6)", "mean_ack_minutes", 1)},
 count(*) FILTER (status IN ('acknowledged', 'open')) AS total_events_logged, 90 AS data_retained_days FROM a)"""


@register("rpt_compliance", f"WITH {A}, {W}, {COMPLIANCE} SELECT * FROM comp")
def compliance(spark, sf):
    return rp.compliance(alerts(spark, sf), audit(spark, sf))


one(
    "rpt_analytics_totals", lambda a: rounded(rp.analytics_totals(a)),
    f"WITH {A} SELECT count(*) AS total_alerts, {r('''count(*) FILTER (status = 'false_positive') / count(*)''', 'false_positive_rate')}, {r('avg(confidence)', 'avg_confidence')} FROM a",
)
one(
    "rpt_analytics_severity", rp.analytics_by_severity,
    f"WITH {A} SELECT s AS severity, count(alert_id) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS s) LEFT JOIN a ON severity = s GROUP BY s",
)
one(
    "rpt_analytics_sources", rp.analytics_sources,
    f"WITH {A} SELECT src_ip, count(*) AS n, max(t_us) AS last_seen_us FROM a GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 10",
)


@register(
    "rpt_alerts_per_hour",
    f"""WITH {ad.cte("alerts")} SELECT b::INT AS bucket, count(alert_id) AS n FROM range(24) t(b)
LEFT JOIN alerts ON t_us BETWEEN {LATE} - 24 * {rp.HOUR_US} AND {LATE} AND 23 - ({LATE} - t_us) // {rp.HOUR_US} = b GROUP BY b""",
)
def per_hour(spark, sf):
    return rp.alerts_per_hour(ad.load(spark, sf, "alerts"), LATE)


one("rpt_protocols", rp.protocol_distribution, f"WITH {A} SELECT coalesce(protocol, 'Other') AS protocol, count(*) AS n FROM a GROUP BY 1")
one("rpt_top_talkers", rp.top_talkers, f"WITH {A} SELECT src_ip, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 5")


def _series_sql(sec):
    w = sec * 1_000_000
    return f"""WITH {ad.cte("packets")}, s AS (SELECT t_us // {w} * {w} AS window_us, count(*) / {sec} AS pps, sum(length) / {sec} AS bps FROM packets GROUP BY 1)"""


for _sec, _name in ((60, "1m"), (300, "5m"), (900, "15m")):
    register(f"rpt_traffic_{_name}", f"{_series_sql(_sec)} SELECT window_us, {r('pps')}, {r('bps')} FROM s")(
        lambda spark, sf, sec=_sec: rounded(rp.traffic_series(ad.load(spark, sf, "packets"), sec))
    )


@register(
    "rpt_traffic_recent",
    f"""{_series_sql(900)}, l AS (SELECT * FROM s ORDER BY window_us DESC LIMIT 40) SELECT count(*) AS points, {r("min(pps)", "pps_min")}, {r("max(pps)", "pps_max")},
 {r("avg(pps)", "pps_avg")}, {r("min(bps)", "bps_min")}, {r("max(bps)", "bps_max")}, {r("avg(bps)", "bps_avg")} FROM l""",
)
def traffic_recent(spark, sf):
    return rounded(rp.traffic_recent(rp.traffic_series(ad.load(spark, sf, "packets"), 900)))


@register(
    "rpt_traffic_moving",
    f"""{_series_sql(900)} SELECT window_us, {r("pps")}, {r("min(pps) OVER w", "pps_min")}, {r("max(pps) OVER w", "pps_max")}, count(*) OVER w AS seen
FROM s WINDOW w AS (ORDER BY window_us RANGE BETWEEN 35100000000 PRECEDING AND CURRENT ROW)""",
)
def traffic_moving(spark, sf):
    return rounded(rp.traffic_moving(rp.traffic_series(ad.load(spark, sf, "packets"), 900), 900))


@register("rpt_period", f"WITH {A} SELECT count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM a")
def period(spark, sf):
    return alerts(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


one("rpt_severity_share", rp.severity_share, f"WITH {A} SELECT severity, count(*) AS n, {r('count(*) * 100 / sum(count(*)) OVER ()', 'share', 1)} FROM a GROUP BY severity")
one("rpt_engine_share", rp.engine_share, f"WITH {A} SELECT detected_by AS engine, count(*) AS n, {r('count(*) * 100 / sum(count(*)) OVER ()', 'share', 1)} FROM a GROUP BY detected_by")
one(
    "rpt_day_bars", rp.day_bars,
    f"WITH {A}, d AS (SELECT strftime(make_timestamp(t_us), '%Y-%m-%d') AS day, count(*) AS n FROM a GROUP BY 1) SELECT day, n, {r('n * 100 / max(n) OVER ()', 'width', 1)} FROM d",
)
_BAND = "CASE WHEN {v} {op} {a} THEN 'PASS' WHEN {v} {op} {b} THEN 'REVIEW' ELSE 'FAIL' END"


@register(
    "rpt_controls",
    f"""WITH {A}, {W}, {COMPLIANCE}, {ENGINES}, m AS (SELECT *, {FPR}, acknowledged_alerts * 100 / total_events_logged AS ack,
 (SELECT {r("avg(confidence)", "c")} FROM a) AS conf, (SELECT {RESOLVED} FROM a) AS res FROM comp, eng), v AS (
SELECT 'acknowledgement_rate' AS control, ack AS value, {_BAND.format(v="ack", op=">=", a=80, b=60)} AS status FROM m
UNION ALL SELECT 'false_positive_rate', false_positive_rate, CASE WHEN false_positive_rate <= 0.05 THEN 'PASS' ELSE 'FAIL' END FROM m
UNION ALL SELECT 'audit_entries', audit_entries, 'PASS' FROM m UNION ALL SELECT 'retention_days', 90, 'PASS' FROM m
UNION ALL SELECT 'mean_ack_minutes', mean_ack_minutes, {_BAND.format(v="mean_ack_minutes", op="<=", a=60, b=120)} FROM m
UNION ALL SELECT 'average_confidence', conf, {_BAND.format(v="conf", op=">=", a=0.9, b=0.7)} FROM m
UNION ALL SELECT 'hybrid_detections', both_triggered, CASE WHEN both_triggered > 0 THEN 'PASS' ELSE 'REVIEW' END FROM m
UNION ALL SELECT 'resolution_rate', res, {_BAND.format(v="res", op=">=", a=0.8, b=0.6)} FROM m) SELECT control, {r("value")}, status FROM v""",
)
def controls(spark, sf):
    return rounded(rp.control_status(alerts(spark, sf), audit(spark, sf)))


@register("rpt_recent_audit", f"WITH {W} SELECT * FROM audit ORDER BY t_us DESC, id DESC LIMIT 50")
def recent_audit(spark, sf):
    return rp.recent_audit(audit(spark, sf))


@register(
    "rpt_locked_accounts",
    f"""WITH {W}, ok AS (SELECT user_id, max(id) AS ok FROM audit WHERE action = 'LOGIN_SUCCESS' GROUP BY 1)
SELECT user_id, count(*) AS failed_attempts FROM audit LEFT JOIN ok USING (user_id) WHERE action = 'LOGIN_FAILED_WRONG_PASSWORD' AND (ok IS NULL OR id > ok)
GROUP BY 1 HAVING count(*) >= 5""",
)
def locked_accounts(spark, sf):
    return rp.locked_accounts(audit(spark, sf))


@register("rpt_expired", f"WITH {W} SELECT count(*) AS n FROM audit WHERE t_us < {NOW} - 20 * 86400000000")
def expired(spark, sf):
    """Over the audit log kept by month."""
    path = scratch_path(spark, "audit")
    tables.write_monthly(audit(spark, sf), path, "t_us")
    return rp.expired(spark.read.parquet(path), NOW, 20).agg(F.count(F.lit(1)).alias("n"))


_JOBS = [
    "o_orderkey AS job_id", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status",
    "o_custkey AS flow_count",
]


def jobs(spark, sf):
    return ad.table(spark, sf, "orders").selectExpr(*_JOBS, "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS created_us")


@register("rpt_jobs", f"SELECT {', '.join(_JOBS)}, epoch_us(o_orderdate) AS created_us FROM orders ORDER BY created_us DESC")
def job_list(spark, sf):
    return rp.job_list(jobs(spark, sf))


@register("rpt_job_outcomes", f"SELECT status, count(*) AS jobs, sum(flow_count)::BIGINT AS flows FROM (SELECT {', '.join(_JOBS)} FROM orders) GROUP BY 1")
def job_outcomes(spark, sf):
    return rp.job_outcomes(jobs(spark, sf))


def _long(section, table, columns, item="''"):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{c}' AS name, {r(f'{c}::DOUBLE', 'value')} FROM {table}" for c in columns
    )


_SEVS = [s.lower() for s in rp.SEVERITIES]


@register(
    "rpt_bundle",
    f"""WITH {A}, {W}, {TYPES_SQL.format(10)}, tt AS (SELECT *, {r("n * 100 / sum(n) OVER ()", "percentage", 1)} FROM t), {SOURCES_SQL}, {DAYS}, {ENGINES}, e2 AS (SELECT *, {FPR} FROM eng),
{COMPLIANCE.replace("FROM audit)", f"FROM audit WHERE t_us BETWEEN {START} AND {END})")}, sv AS (SELECT {SEV_COUNTS}, count(*) AS total FROM a), cf AS (SELECT {r("avg(confidence)", "average_confidence")} FROM a),
ph AS (SELECT hour(make_timestamp(t_us))::INT AS peak_hour, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1), rs AS (SELECT {RESOLVED} FROM a)
{_long("severity", "sv", [*_SEVS, "total"])} UNION ALL {_long("attack_types", "tt", ["n", "percentage"], "attack_type")}
UNION ALL {_long("sources", "sources", ["n", "first_seen_us", "last_seen_us"], "src_ip")} UNION ALL {_long("timeline", "days", _SEVS, "day")}
UNION ALL {_long("engines", "e2", ["signature_triggered", "ml_triggered", "both_triggered", "false_positive_count", "false_positive_rate"])}
UNION ALL {_long("confidence", "cf", ["average_confidence"])} UNION ALL {_long("peak_hour", "ph", ["peak_hour", "n"])} UNION ALL {_long("resolution", "rs", ["resolution_rate"])}
UNION ALL {_long("compliance", "comp", ["audit_entries", "acknowledged_alerts", "unacknowledged_alerts", "mean_ack_minutes", "total_events_logged", "data_retained_days"])}""",
)
def bundle(spark, sf):
    tables = rp.bundle(ad.load(spark, sf, "alerts"), audit(spark, sf), START, END, "compliance")
    return rounded(rp.bundle_long(tables))
