"""Alert records, validation, search, notes, workflow, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import fold, ordered, skew
from tidewatch.operators.ensemble import severity
from tidewatch.operators.rules import literal_map
from tidewatch.session import cut_lineage

# Text shown for each attack type.
DESCRIPTIONS = {
    "DoS": "Denial of Service attack detected — high-volume traffic aimed at exhausting target resources.",
    "DDoS": "Distributed Denial of Service attack detected — coordinated flood from multiple sources.",
    "PortScan": "Port scanning activity detected — systematic probing of open services on the target host.",
    "BruteForce": "Brute-force authentication attack detected — repeated login attempts to gain unauthorised access.",
    "Botnet": "Botnet command-and-control communication detected — host may be compromised.",
    "WebAttack": "Web application attack detected — includes SQL injection, XSS, or CSRF patterns.",
    "Infiltration": "Multi-stage infiltration activity detected — possible lateral movement or data exfiltration.",
    "ANOMALY": "Statistically anomalous traffic detected — deviates significantly from the established baseline.",
}
RECOMMENDED_ACTIONS = {
    "DoS": "1) Verify legitimacy of high-volume source. 2) Apply rate limiting or ACL at edge router. 3) Notify upstream ISP if attack is external.",
    "DDoS": "1) Activate DDoS mitigation controls. 2) Contact ISP for upstream filtering. 3) Enable cloud scrubbing if available.",
    "PortScan": "1) Block source IP at perimeter firewall if scan is unauthorised. 2) Review firewall rules for exposed services. 3) Check for subsequent exploit attempts from same source.",
    "BruteForce": "1) Temporarily block source IP. 2) Check if any accounts were compromised. 3) Enforce MFA on targeted service. 4) Review authentication logs.",
    "Botnet": "1) Isolate the affected host immediately. 2) Run endpoint malware scan. 3) Block C2 IP/domain at DNS and firewall. 4) Preserve memory and disk image for forensics.",
    "WebAttack": "1) Check application logs for successful exploitation. 2) Apply WAF rules for the detected pattern. 3) Review and patch vulnerable application endpoints.",
    "Infiltration": "1) Isolate affected systems. 2) Preserve forensic evidence. 3) Identify lateral movement path. 4) Notify security management and initiate incident response plan.",
    "ANOMALY": "1) Investigate the anomalous flow manually. 2) Determine if the behaviour is expected (e.g. new application, scheduled job). 3) Mark as false positive if benign, or escalate if suspicious.",
}
DEFAULT_DESCRIPTION = "Suspicious network activity detected by the detection engine."
DEFAULT_ACTION = "Investigate the alert in the dashboard. Acknowledge and add investigation notes."
# Severity midpoints, domains, roles, workflow.
MIDPOINTS = {"CRITICAL": 0.97, "HIGH": 0.90, "MEDIUM": 0.75, "LOW": 0.55}
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
DETECTED_BY = ["signature", "ml", "both"]
ROLE_SEVERITIES = {
    "system_admin": SEVERITIES,
    "soc_manager": SEVERITIES,
    "network_admin": SEVERITIES,
    "read_only_analyst": ["MEDIUM", "LOW"],
}
STATES = ["open", "acknowledged", "escalated", "false_positive", "resolved"]
# action -> (states it may start from, state it leads to, audit code)
TRANSITIONS = {
    "acknowledge": (["open"], "acknowledged", "ALERT_ACKNOWLEDGE"),
    "escalate": (["open", "acknowledged"], "escalated", "ALERT_ESCALATE"),
    "false_positive": (["open", "acknowledged"], "false_positive", "ALERT_FALSE_POSITIVE"),
    "resolve": (["acknowledged", "escalated", "false_positive"], "resolved", "ALERT_RESOLVE"),
    "reopen": (["resolved", "false_positive"], "open", "ALERT_REOPEN"),
}
RESOLUTION_TYPES = ["true_positive", "false_positive", "benign", "duplicate"]
FALSE_POSITIVE_NOTE = "Marked as false positive by analyst."


def looked_up(values: dict, key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def build_alerts(events: DataFrame) -> DataFrame:
    """Correlated event to alert record; the id repeats for the same event."""
    kind = F.when(F.col("attack_type") == "BENIGN", "ANOMALY").otherwise(F.col("attack_type"))
    out = events.withColumn("attack_type", kind)
    return out.withColumns(
        {
            "alert_id": F.md5(F.concat_ws("|", "flow_id", "attack_type", F.col("t_us").cast("string"))),
            "severity": severity(F.col("confidence")),
            "description": looked_up(DESCRIPTIONS, F.col("attack_type"), DEFAULT_DESCRIPTION),
            "recommended_action": looked_up(RECOMMENDED_ACTIONS, F.col("attack_type"), DEFAULT_ACTION),
            "status": F.lit("open"),
        }
    )


def midpoint(sev: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(MIDPOINTS), F.upper(sev)), F.lit(0.55))


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))


def described(alerts: DataFrame) -> DataFrame:
    """The three description wordings."""
    sp, dp, proto = _or("src_port", "*"), _or("dst_port", "*"), _or("protocol", "unknown")
    label = F.coalesce(
        F.try_element_at(
            literal_map({"signature": "Signature rule match", "ml": "ML ensemble detection", "both": "Signature + ML corroboration"}),
            F.col("detected_by"),
        ),
        F.lit("Detection"),
    )
    return alerts.withColumns(
        {
            "ingest_text": F.format_string(
                "%s severity %s detected from %s:%s → %s:%s via %s (confidence=%.3f, engine=%s)",
                "severity", "attack_type", "src_ip", sp, "dst_ip", dp, proto, "confidence", "detected_by",
            ),
            "connector_text": F.format_string(
                "%s severity %s detected. Source: %s:%s → Destination: %s:%s via %s. Ensemble confidence: %.3f. Detected by: %s.",
                "severity", "attack_type", "src_ip", sp, "dst_ip", dp, proto, "confidence", "detected_by",
            ),
            "service_text": F.format_string(
                "%s: %s detected from %s → %s:%s (confidence %.2f)",
                label, "attack_type", "src_ip", "dst_ip", _or("dst_port", "?"), "confidence",
            ),
        }
    )


def validated(alerts: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (NULL = valid) and normalise the two enums."""
    port = lambda c: F.coalesce(~F.col(c).between(0, 65535), F.lit(False))
    long = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    missing = F.col("src_ip").isNull() | F.col("dst_ip").isNull() | F.col("attack_type").isNull()
    reason = (
        F.when(missing, "missing_field")
        .when(long("attack_type", 64) | long("src_ip", 45) | long("dst_ip", 45) | long("protocol", 8) | long("description", 2000), "too_long")
        .when(~F.coalesce(F.upper("severity").isin(SEVERITIES), F.lit(False)), "bad_severity")
        .when(~F.coalesce(F.lower("detected_by").isin(DETECTED_BY), F.lit(False)), "bad_detected_by")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "bad_confidence")
        .when(port("src_port") | port("dst_port"), "bad_port")
    )
    return alerts.withColumn("reject_reason", reason).withColumns(
        {"severity": F.upper("severity"), "detected_by": F.lower("detected_by")}
    )


def filtered(
    alerts: DataFrame, severity: str | None = None, status: str | None = None, src_ip: str | None = None,
    attack_type: str | None = None, from_us: int | None = None, to_us: int | None = None,
) -> DataFrame:
    for cond in (
        severity and F.col("severity") == severity.upper(),
        status and F.col("status") == status.lower(),
        src_ip and F.col("src_ip") == src_ip,
        attack_type and F.col("attack_type") == attack_type,
        from_us is not None and F.col("t_us") >= from_us,
        to_us is not None and F.col("t_us") <= to_us,
    ):
        if isinstance(cond, Column):
            alerts = alerts.filter(cond)
    return alerts


def page(alerts: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Newest first; offset and limit run as one top-k, not a full sort."""
    return alerts.orderBy(F.col("t_us").desc(), "alert_id").offset((number - 1) * size).limit(size)


def lookup(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def search(alerts: DataFrame, text: str, severity: str = "all", status: str = "all") -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "alert_id", "attack_type", "src_ip", "dst_ip", "detected_by"))
    out = alerts.filter(hay.contains(text.lower()))
    if severity != "all":
        out = out.filter(F.col("severity") == severity)
    return out if status == "all" else out.filter(F.col("status") == status)


def sorted_by(alerts: DataFrame, column: str, descending: bool = False) -> DataFrame:
    c = F.col(column)
    return alerts.orderBy(c.desc() if descending else c.asc(), "alert_id")


def status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def live_feed(alerts: DataFrame, size: int = 80) -> DataFrame:
    """The newest distinct alerts with the share of attacks among them."""
    one = alerts.groupBy("alert_id").agg(F.max(F.struct("t_us", "attack_type", "severity")).alias("a"))
    top = one.select("alert_id", "a.*").orderBy(F.col("t_us").desc(), "alert_id").limit(size)
    rate = top.agg(
        F.round(F.count_if(F.col("severity") != "LOW") * 100.0 / F.count(F.lit(1)), 1).cast("double").alias("alert_rate")
    )
    return top.crossJoin(F.broadcast(rate))


def parse_notes(description: Column) -> Column:
    """``[Note] <iso time> <text>`` lines to an array of (ts, text)."""
    lines = F.filter(F.split(description, r"\r\n|\n|\r"), lambda x: x.startswith("[Note]"))
    bodies = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(7), F.length(x)))), lambda x: x != "")
    pattern = r"^([0-9TZ:.\-]+)\s+(.*)$"

    def one(x):
        ts = F.regexp_replace(F.regexp_extract(x, pattern, 1), "Z$", "").try_cast("timestamp_ntz")
        stamped = x.rlike(pattern)
        good = F.regexp_extract(x, pattern, 1).rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?)?Z?$")
        return F.struct(
            F.when(stamped & good, ts).alias("ts"),
            F.when(stamped, F.regexp_extract(x, pattern, 2)).otherwise(x).alias("text"),
        )

    return F.coalesce(F.transform(bodies, one), F.array().cast("array<struct<ts:timestamp_ntz,text:string>>"))


def append_notes(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Append a batch of notes (alert_id, t_us, note) to the descriptions, in order.

    Blank notes are skipped. The notes of one alert end up in one text value, so
    they are gathered per alert here; that text is the result, not a by-product.
    """
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat(F.lit("[Note] "), stamp, F.lit(" "), F.trim("note"))
    per = (
        notes.filter(F.trim("note") != "")
        .groupBy("alert_id")
        .agg(F.sort_array(F.collect_list(F.struct("t_us", line.alias("line")))).alias("l"))
        .select("alert_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("added"))
    )
    text = F.concat_ws("\n", F.nullif(F.col("description"), F.lit("")), "added")
    return alerts.join(per, "alert_id", "left").withColumn("description", text).drop("added")


# --- workflow --------------------------------------------------------------


def _state_index(name: str) -> int:
    return STATES.index(name)


def legal(actions: DataFrame) -> Column:
    """Row-level conditions of an action, regardless of the alert's state."""
    return (F.col("action") != "resolve") | (
        F.coalesce(F.col("resolution_type").isin(RESOLUTION_TYPES), F.lit(False))
        & (F.coalesce(F.trim("note"), F.lit("")) != "")
    )


def apply_actions(actions: DataFrame, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Replay analyst actions (action_id, t_us, alert_id, action, ...) per alert.

    Adds previous_status, accepted and new_status; illegal actions change nothing.
    """
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    step = identity
    for name, (sources, target, _) in TRANSITIONS.items():
        moved = F.array(
            *[F.lit(_state_index(target) if s in sources else i) for i, s in enumerate(STATES)]
        )
        step = F.when(legal(actions) & (F.col("action") == name), moved).otherwise(step)
    log = actions.withColumn("__chunk", ordered.time_chunk("t_us", chunk_us))
    done = fold.replay(log, ["alert_id"], "__chunk", ["t_us", "action_id"], step, len(STATES))
    names = F.array(*[F.lit(s) for s in STATES])
    before = F.element_at(names, F.col("state_before") + 1)
    allowed, target = F.lit(False), F.lit(None).cast("string")
    for name, (sources, to, _) in TRANSITIONS.items():
        mine = F.col("action") == name
        allowed = F.when(mine, before.isin(sources)).otherwise(allowed)
        target = F.when(mine, F.lit(to)).otherwise(target)
    return (
        done.withColumn("previous_status", before)
        .withColumn("accepted", legal(done) & allowed)
        .withColumn("new_status", F.when(F.col("accepted"), target).otherwise(before))
        .drop("state_before")
    )


def audit_rows(applied: DataFrame) -> DataFrame:
    """One audit entry per accepted action with its detail as JSON."""
    code = F.lit(None).cast("string")
    for name, (_, _, audit) in TRANSITIONS.items():
        code = F.when(F.col("action") == name, audit).otherwise(code)
    plain = F.to_json(F.struct("previous_status", "note"), {"ignoreNullFields": "false"})
    closing = F.to_json(
        F.struct("previous_status", "resolution_type", F.col("note").alias("resolution_note")),
        {"ignoreNullFields": "false"},
    )
    return applied.filter("accepted").select(
        F.md5(F.concat_ws("|", "alert_id", F.col("action_id").cast("string"))).alias("id"),
        F.col("performed_by").alias("user_id"),
        code.alias("action"),
        F.lit("alert").alias("entity_type"),
        F.col("alert_id").alias("entity_id"),
        F.when(F.col("action") == "resolve", closing).otherwise(plain).alias("detail"),
        F.col("t_us").alias("created_us"),
    )


def workflow_state(applied: DataFrame) -> DataFrame:
    """Status and side fields per alert after all actions."""
    ok = applied.filter("accepted").withColumn("at", F.struct("t_us", "action_id"))

    def latest(value, *names):
        return F.max_by(value, F.when(F.col("action").isin(*names), F.col("at")))

    closing = ("false_positive", "resolve")
    kind = F.when(F.col("action") == "false_positive", F.lit("false_positive")).otherwise(F.col("resolution_type"))
    note = F.when(
        F.col("action") == "false_positive",
        F.coalesce(F.nullif(F.col("note"), F.lit("")), F.lit(FALSE_POSITIVE_NOTE)),
    ).otherwise(F.trim("note"))
    return ok.groupBy("alert_id").agg(
        F.max_by("new_status", "at").alias("status"),
        latest(F.col("performed_by"), "acknowledge").alias("acknowledged_by"),
        latest(F.col("t_us"), "acknowledge").alias("acknowledged_us"),
        latest(F.col("performed_by"), "escalate").alias("escalated_by"),
        latest(F.col("t_us"), "escalate").alias("escalated_us"),
        latest(F.col("performed_by"), *closing).alias("resolved_by"),
        latest(F.col("t_us"), *closing).alias("resolved_us"),
        latest(kind, *closing).alias("resolution_type"),
        latest(note, *closing).alias("resolution_note"),
        F.count(F.lit(1)).alias("accepted_actions"),
    )


def status_events(applied: DataFrame, alerts: DataFrame) -> DataFrame:
    """Status-change payload for every accepted action."""
    sev = alerts.select("alert_id", "severity")
    accepted = applied.filter("accepted").select("action_id", "alert_id", "new_status", "performed_by", "t_us")
    rows = skew.salted_join(cut_lineage(accepted, "accepted"), sev, ["alert_id"], "left")
    return rows.select(
        "action_id",
        F.to_json(
            F.struct(
                F.lit("alert.status_changed").alias("event"), "alert_id", "new_status",
                F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"), "performed_by",
                (F.col("t_us") / 1e6).alias("timestamp"),
            )
        ).alias("payload"),
    )


def new_alert_events(alerts: DataFrame) -> DataFrame:
    """Payload announced for every new alert."""
    return alerts.select(
        "alert_id",
        F.to_json(
            F.struct(
                "alert_id", "severity", "attack_type", "src_ip", F.round("confidence", 4).alias("confidence"),
                "attack_chain", "status", (F.col("t_us") / 1e6).alias("detected_at"),
            )
        ).alias("payload"),
    )


def notifications(alerts: DataFrame, product: str = "Security") -> DataFrame:
    """Subject and body for HIGH and CRITICAL alerts."""
    a = alerts.filter(F.col("severity").isin("HIGH", "CRITICAL"))
    subject = F.concat(
        F.when(F.col("status") == "escalated", "[ESCALATED] ").otherwise(""),
        F.lit(f"{product} "), "severity", F.lit(" Alert: "), "attack_type", F.lit(" from "), "src_ip",
        F.when(F.col("attack_chain"), " ⚠ ATTACK CHAIN").otherwise(""),
    )
    body = F.format_string(
        "Alert ID     : %s\nSeverity     : %s\nAttack Type  : %s\nSource IP    : %s\nDestination  : %s\n"
        "Confidence   : %.1f%%\nDetected by  : %s",
        "alert_id", "severity", "attack_type", "src_ip", "dst_ip", F.col("confidence") * 100 + 1e-9, "detected_by",
    )
    return a.select("alert_id", subject.alias("subject"), body.alias("body"))


def visible_to(alerts: DataFrame, role: str) -> DataFrame:
    return alerts.filter(F.col("severity").isin(ROLE_SEVERITIES.get(role, [])))


def visibility(alerts: DataFrame) -> DataFrame:
    """Every (role, alert) a role may see; roles and severities are a fixed table."""
    roles = F.array(
        *[F.struct(F.lit(r).alias("role"), F.array(*[F.lit(s) for s in sv]).alias("may")) for r, sv in ROLE_SEVERITIES.items()]
    )
    seen = F.filter(roles, lambda r: F.array_contains(r["may"], F.col("severity")))
    return alerts.select("*", F.explode(F.transform(seen, lambda r: r["role"])).alias("role"))


def iso_time(t_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_label(t_us: Column, now_us: int) -> Column:
    sec = (F.lit(now_us) - t_us) / 1e6
    whole = lambda d: F.floor(sec / d).cast("string")
    return (
        F.when(sec < 10, "just now")
        .when(sec < 60, F.concat(whole(1), F.lit("s ago")))
        .when(sec < 3600, F.concat(whole(60), F.lit("m ago")))
        .otherwise(F.concat(whole(3600), F.lit("h ago")))
    )
