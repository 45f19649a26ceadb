from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts
from tidewatch.plans import reports
from tidewatch.sources import tables

ACTIONS = "action_id long, t_us long, alert_id string, action string, performed_by string, note string, resolution_type string"


def run(spark, *steps):
    data = [
        (i, i, "a", s if isinstance(s, str) else s[0], "ann", None if isinstance(s, str) else s[1], None if isinstance(s, str) else s[2])
        for i, s in enumerate(steps)
    ]
    return alerts.apply_actions(spark.createDataFrame(data, ACTIONS)).orderBy("action_id")


CLOSE = ("resolve", "done", "benign")


@pytest.mark.parametrize(
    ("steps", "accepted", "status"),
    [
        (["acknowledge"], [1], "acknowledged"),
        (["acknowledge", "acknowledge"], [1, 0], "acknowledged"),
        (["escalate"], [1], "escalated"),
        (["acknowledge", "escalate", "escalate"], [1, 1, 0], "escalated"),
        (["false_positive"], [1], "false_positive"),
        (["acknowledge", "false_positive", CLOSE, "reopen"], [1, 1, 1, 1], "open"),
        ([CLOSE], [0], "open"),
        (["acknowledge", ("resolve", "x", "wrong")], [1, 0], "acknowledged"),
        (["acknowledge", ("resolve", "  ", "benign")], [1, 0], "acknowledged"),
        (["false_positive", "reopen", "escalate", CLOSE], [1, 1, 1, 1], "resolved"),
        (["reopen"], [0], "open"),
        (["unknown"], [0], "open"),
    ],
)
def test_workflow(spark, steps, accepted, status):
    out = run(spark, *steps).collect()
    assert [int(r["accepted"]) for r in out] == accepted and out[-1]["new_status"] == status


def test_side_fields_and_audit(spark):
    out = run(spark, "acknowledge", "false_positive", ("resolve", " ok ", "duplicate"))
    s = alerts.workflow_state(out).first()
    assert (s["status"], s["acknowledged_by"], s["resolution_type"], s["resolution_note"]) == ("resolved", "ann", "duplicate", "ok")
    s = alerts.workflow_state(run(spark, "false_positive")).first()
    assert (s["resolution_type"], s["resolution_note"]) == ("false_positive", alerts.FALSE_POSITIVE_NOTE)
    audit = [(r["action"], r["detail"]) for r in alerts.audit_rows(out).orderBy("created_us").collect()]
    assert audit[0] == ("ALERT_ACKNOWLEDGE", '{"previous_status":"open","note":null}')
    assert audit[2][1] == '{"previous_status":"false_positive","resolution_type":"duplicate","resolution_note":" ok "}'


def test_notes(spark):
    text = "head\n[Note] 2024-05-01T10:00:00Z first\r\n[Note] plain\n[Note]   \n [Note] no\n[Note] 2024-99-01T10:00:00Z odd"
    df = spark.createDataFrame([(text,), (None,)], "d string").select(F.size(alerts.parse_notes(F.col("d"))), alerts.parse_notes(F.col("d")))
    try:
        a, b = df.collect()
    except Exception:
        pytest.fail("an impossible time must not fail the row")
    assert b[0] == 0
    assert [(n["ts"], n["text"]) for n in a[1]] == [(datetime(2024, 5, 1, 10), "first"), (None, "plain"), (None, "odd")]


def test_period():
    now = datetime(2024, 5, 10, 12)
    day = 86_400_000_000
    assert reports.period(now, "24h") == (reports.micros(now) - day, reports.micros(now))
    assert reports.period(now)[0] == reports.micros(now) - 7 * day
    lo, hi = reports.period(now, None, "2024-05-01", "2024-05-01")
    assert hi - lo == day - 1_000_000
    with pytest.raises(ValueError, match="after"):
        reports.period(now, None, "2024-05-02", "2024-05-01")


ALERTS = (
    "alert_id string, t_us long, severity string, attack_type string, src_ip string, detected_by string, status string, "
    "confidence double, ack_us long, protocol string"
)


def test_report_without_alerts(spark):
    a = spark.createDataFrame([], ALERTS)
    audit = spark.createDataFrame([], "id long, user_id string, action string, t_us long")
    b = reports.bundle(a, audit, 0, 1, "compliance")
    assert tuple(b["severity"].first()) == (0, 0, 0, 0, 0)
    assert b["engines"].first()["false_positive_rate"] == 0 and b["resolution"].first()[0] == 0
    assert b["attack_types"].count() == b["sources"].count() == b["peak_hour"].count() == 0
    assert b["compliance"].first()["mean_ack_minutes"] == 0 and reports.analytics_by_severity(a).count() == 4
    assert reports.alerts_per_hour(a, 10**15).agg(F.sum("n"), F.count("n")).first()[:] == (0, 24)


def test_false_positive_rate(spark):
    rows = [("signature", 30), ("ml", 20), ("both", 10)]
    data, i = [], 0
    for by, n in rows:
        for _ in range(n):
            data.append((str(i), i, "LOW", "DoS", "x", by, "false_positive" if i < 2 else "open", 0.5, None, None))
            i += 1
    assert reports.engine_stats(spark.createDataFrame(data, ALERTS)).first()["false_positive_rate"] == 0.0333


def test_insert_is_idempotent(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "alert_id string, v int")
    old = spark.createDataFrame([("b", 9)], "alert_id string, v int")
    assert [tuple(r) for r in tables.new_rows(new, old).collect()] == [("a", 1)]


def test_monthly_pruning(spark, tmp_path):
    df = spark.createDataFrame([(reports.micros(datetime(2023 + m // 12, m % 12 + 1, 3)), m) for m in range(24)], "t long, m int")
    tables.write_monthly(df, str(tmp_path / "t"), "t")
    got = tables.read_monthly(spark, str(tmp_path / "t"), (2023, 11), (2024, 2))
    assert sorted(r["m"] for r in got.collect()) == [10, 11, 12, 13]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_role_visibility(spark):
    df = spark.createDataFrame([("1", s) for s in alerts.SEVERITIES], "alert_id string, severity string")
    assert sorted(r["severity"] for r in alerts.visible_to(df, "read_only_analyst").collect()) == ["LOW", "MEDIUM"]
    assert alerts.visible_to(df, "nobody").count() == 0
