"""Report, analytics and compliance queries over alerts and the audit log."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import skew

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
RANGES = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}
RETENTION_DAYS = 90
HOUR_US = 3_600_000_000
LOGIN_FAILED = "LOGIN_FAILED_WRONG_PASSWORD"
LOGIN_OK = "LOGIN_SUCCESS"


def micros(t: datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def period(
    now: datetime, range_: str | None = None, start_date: str | None = None, end_date: str | None = None
) -> tuple[int, int]:
    """Bounds in microseconds: a range back from now, or whole days, or 7 days."""
    if range_:
        return micros(now - RANGES[range_]), micros(now)
    if not start_date or not end_date:
        return micros(now - timedelta(days=7)), micros(now)
    start = datetime.fromisoformat(start_date).replace(hour=0, minute=0, second=0)
    end = datetime.fromisoformat(end_date).replace(hour=23, minute=59, second=59)
    if end <= start:
        raise ValueError("end_date must be after start_date")
    return micros(start), micros(end)


def _months(df: DataFrame, first_us: int | None, last_us: int | None) -> DataFrame:
    """Of a table kept by month, only the months that a time span touches."""
    if not {"year", "month"} <= set(df.columns):
        return df
    at = F.col("year") * 12 + F.col("month")
    for us, keep in ((first_us, at.__ge__), (last_us, at.__le__)):
        if us is not None:
            day = datetime(1970, 1, 1) + timedelta(microseconds=us)
            df = df.filter(keep(day.year * 12 + day.month))
    return df


def in_period(df: DataFrame, start_us: int, end_us: int, t: str = "t_us") -> DataFrame:
    return _months(df, start_us, end_us).filter(F.col(t).between(start_us, end_us))


def _r(c: Column, digits: int) -> Column:
    """Half-up rounding that is not misled by the last bit."""
    return F.round(c + 1e-9, digits)


def _n(cond: Column | str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def severity_breakdown(a: DataFrame) -> DataFrame:
    return a.agg(*[_n(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]).withColumn(
        "total", F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    )


def top_attack_types(a: DataFrame, top_n: int = 10) -> DataFrame:
    """Most frequent types; the percentage is of the listed rows."""
    top = a.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "attack_type").limit(top_n)
    total = top.agg(F.sum("n").alias("listed"))
    return top.crossJoin(F.broadcast(total)).select(
        "attack_type", "n", _r(F.col("n") * 100 / F.col("listed"), 1).alias("percentage")
    )


def top_sources(a: DataFrame, top_n: int = 10) -> DataFrame:
    """Busiest sources with their most frequent type, counted in two levels so that
    a hot source reaches its reducer as a handful of rows."""
    per_type = a.groupBy("src_ip", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("lo"), F.max("t_us").alias("hi")
    )
    # most rows first, then the smaller name: the least of (-n, type)
    best = F.min(F.struct((-F.col("n")).alias("m"), "attack_type"))["attack_type"]
    return (
        per_type.groupBy("src_ip")
        .agg(F.sum("n").alias("n"), best.alias("top_attack"), F.min("lo").alias("first_seen_us"), F.max("hi").alias("last_seen_us"))
        .orderBy(F.col("n").desc(), "src_ip")
        .limit(top_n)
    )


def daily_timeline(a: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd").alias("day")
    return a.groupBy(day).agg(*[_n(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]).orderBy("day")


def engine_stats(a: DataFrame) -> DataFrame:
    out = a.agg(
        _n("detected_by LIKE '%signature%'").alias("signature_triggered"),
        _n("detected_by LIKE '%ml%'").alias("ml_triggered"),
        _n("detected_by LIKE '%both%'").alias("both_triggered"),
        _n("status = 'false_positive'").alias("false_positive_count"),
    )
    total = F.col("signature_triggered") + F.col("ml_triggered") + F.col("both_triggered")
    return out.withColumn("false_positive_rate", _r(_ratio(F.col("false_positive_count"), total), 4))


def average_confidence(a: DataFrame) -> DataFrame:
    return a.agg(_r(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("average_confidence"))


def peak_hour(a: DataFrame) -> DataFrame:
    h = F.hour(F.timestamp_micros("t_us")).alias("peak_hour")
    return a.groupBy(h).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "peak_hour").limit(1)


def resolution_rate(a: DataFrame) -> DataFrame:
    done = _n("status IN ('acknowledged', 'false_positive')")
    return a.agg(_r(_ratio(done, F.count(F.lit(1))), 4).alias("resolution_rate"))


def compliance(a: DataFrame, audit: DataFrame, retained_days: int = RETENTION_DAYS) -> DataFrame:
    entries = audit.agg(F.count(F.lit(1)).alias("audit_entries"))
    acks = a.agg(
        _n("status = 'acknowledged'").alias("acknowledged_alerts"),
        _n("status = 'open'").alias("unacknowledged_alerts"),
        _r(F.coalesce(F.avg((F.col("ack_us") - F.col("t_us")) / 60e6), F.lit(0.0)), 1).alias("mean_ack_minutes"),
    )
    return entries.crossJoin(acks).withColumn(
        "total_events_logged", F.col("acknowledged_alerts") + F.col("unacknowledged_alerts")
    ).withColumn("data_retained_days", F.lit(retained_days))


def analytics_by_severity(a: DataFrame) -> DataFrame:
    """All four severities, absent ones with 0."""
    counts = severity_breakdown(a)
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in SEVERITIES])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def analytics_totals(a: DataFrame) -> DataFrame:
    fp = _n("status = 'false_positive'")
    return a.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        _ratio(fp, F.count(F.lit(1))).alias("false_positive_rate"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def analytics_sources(a: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        a.filter("src_ip IS NOT NULL").groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("n"), F.max("t_us").alias("last_seen_us"))
        .orderBy(F.col("n").desc(), "src_ip").limit(top_n)
    )


def alerts_per_hour(a: DataFrame, now_us: int, hours: int = 24) -> DataFrame:
    """Dense hourly buckets, oldest first; bucket hours-1 ends now."""
    ago = F.floor((F.lit(now_us) - F.col("t_us")) / HOUR_US).cast("int")
    n = (
        a.filter(F.col("t_us").between(now_us - hours * HOUR_US, now_us))
        .withColumn("ago", ago).filter(F.col("ago") < hours)
        .groupBy((F.lit(hours - 1) - F.col("ago")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )
    axis = a.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket"))
    return axis.join(F.broadcast(n), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def protocol_distribution(a: DataFrame) -> DataFrame:
    p = F.coalesce(F.nullif(F.col("protocol"), F.lit("")), F.lit("Other"))
    return a.groupBy(p.alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def top_talkers(a: DataFrame, top_n: int = 5) -> DataFrame:
    return a.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "src_ip").limit(top_n)


def traffic_series(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """Packets and bytes per second in tumbling windows."""
    width = seconds * 1_000_000
    slot = (F.floor(F.col("t_us") / width) * width).cast("long").alias("window_us")
    return packets.groupBy(slot).agg(
        (F.count(F.lit(1)) / F.lit(seconds)).alias("pps"), (F.sum("length") / F.lit(seconds)).alias("bps")
    )


def traffic_recent(series: DataFrame, points: int = 40) -> DataFrame:
    """Extremes and averages of the newest points of a series."""
    last = series.orderBy(F.col("window_us").desc()).limit(points)
    out = [F.count(F.lit(1)).alias("points")]
    for c in ("pps", "bps"):
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_avg")]
    return last.agg(*out)


def traffic_moving(series: DataFrame, seconds: int, points: int = 40, day_us: int = 86_400_000_000) -> DataFrame:
    """Extremes over the last ``points`` windows at each window.

    The series (one row per time window) is cut by day with a halo of ``points``
    windows on each cut, so no single task orders the whole history. The frame is by
    window time, as every window keeps its slot.
    """
    width = seconds * 1_000_000
    halo = points * width
    home = F.floor(F.col("window_us") / day_us)
    reach = F.floor((F.col("window_us") + halo) / day_us)
    spread = series.withColumn("home", home).withColumn("day", F.explode(F.sequence(home, reach)))
    w = Window.partitionBy("day").orderBy("window_us").rangeBetween(-(halo - width), 0)
    return (
        spread.withColumns({"pps_max": F.max("pps").over(w), "pps_min": F.min("pps").over(w), "seen": F.count("pps").over(w)})
        .filter("day = home").select("window_us", "pps", "pps_min", "pps_max", "seen")
    )


def severity_share(a: DataFrame) -> DataFrame:
    n = analytics_by_severity(a)
    total = n.agg(F.greatest(F.sum("n"), F.lit(1)).alias("t"))
    return n.crossJoin(F.broadcast(total)).select("severity", "n", _r(F.col("n") * 100 / F.col("t"), 1).alias("share"))


def engine_share(a: DataFrame) -> DataFrame:
    e = engine_stats(a)
    names = [("signature", "signature_triggered"), ("ml", "ml_triggered"), ("both", "both_triggered")]
    total = F.greatest(sum((F.col(c) for _, c in names[1:]), F.col(names[0][1])), F.lit(1))
    rows = F.array(
        *[F.struct(F.lit(k).alias("engine"), F.col(c).alias("n"), _r(F.col(c) * 100 / total, 1).alias("share")) for k, c in names]
    )
    return e.select(F.explode(rows).alias("x")).select("x.*")


def day_bars(a: DataFrame) -> DataFrame:
    """Days scaled to the busiest one."""
    d = daily_timeline(a).withColumn("n", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))
    top = d.agg(F.greatest(F.max("n"), F.lit(1)).alias("m"))
    return d.crossJoin(F.broadcast(top)).select("day", "n", _r(F.col("n") * 100 / F.col("m"), 1).alias("width"))


def control_status(a: DataFrame, audit: DataFrame, retained_days: int = RETENTION_DAYS) -> DataFrame:
    """Each control with its measured value and PASS / REVIEW / FAIL band."""
    m = (
        compliance(a, audit, retained_days)
        .crossJoin(engine_stats(a))
        .crossJoin(average_confidence(a))
        .crossJoin(resolution_rate(a))
        .crossJoin(severity_breakdown(a))
    )
    total = F.col("acknowledged_alerts") + F.col("unacknowledged_alerts")
    ack = _ratio(F.col("acknowledged_alerts") * 100, total)

    def at_least(value, good, fair=None):
        out = F.when(value >= good, "PASS")
        return (out.when(value >= fair, "REVIEW") if fair is not None else out).otherwise("FAIL")

    def at_most(value, good, fair=None):
        out = F.when(value <= good, "PASS")
        return (out.when(value <= fair, "REVIEW") if fair is not None else out).otherwise("FAIL")

    fpr = F.col("false_positive_rate")
    c = F.col
    controls = [
        ("acknowledgement_rate", ack, at_least(ack, 80, 60)),
        ("false_positive_rate", fpr, at_most(fpr, 0.05)),
        ("audit_entries", c("audit_entries"), F.when(c("audit_entries") > 0, "PASS").otherwise("FAIL")),
        ("retention_days", c("data_retained_days"), at_least(c("data_retained_days"), 90)),
        ("mean_ack_minutes", c("mean_ack_minutes"), at_most(c("mean_ack_minutes"), 60, 120)),
        ("average_confidence", c("average_confidence"), at_least(c("average_confidence"), 0.90, 0.70)),
        ("hybrid_detections", c("both_triggered"), F.when(c("both_triggered") > 0, "PASS").otherwise("REVIEW")),
        ("resolution_rate", c("resolution_rate"), at_least(c("resolution_rate"), 0.80, 0.60)),
    ]
    rows = F.array(
        *[F.struct(F.lit(n).alias("control"), v.cast("double").alias("value"), s.alias("status")) for n, v, s in controls]
    )
    return m.select(F.explode(rows).alias("x")).select("x.*")


def recent_audit(audit: DataFrame, n: int = 50) -> DataFrame:
    return audit.orderBy(F.col("t_us").desc(), F.col("id").desc()).limit(n)


def locked_accounts(audit: DataFrame, limit: int = 5) -> DataFrame:
    """Users with at least ``limit`` failed logins since their last success."""
    ok = audit.filter(F.col("action") == LOGIN_OK).groupBy("user_id").agg(F.max(F.struct("t_us", "id")).alias("ok"))
    bad = audit.filter(F.col("action") == LOGIN_FAILED).select("user_id", F.struct("t_us", "id").alias("at"))
    return (
        skew.salted_join(bad, ok, ["user_id"], "left")
        .filter("ok IS NULL OR at > ok")
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("failed_attempts"))
        .filter(F.col("failed_attempts") >= limit)
    )


def expired(df: DataFrame, now_us: int, days: int = RETENTION_DAYS, t: str = "t_us") -> DataFrame:
    """Rows older than the retention; of a table kept by month, the later months are not read."""
    before = now_us - days * 86_400_000_000
    return _months(df, None, before).filter(F.col(t) < before)


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_us").desc(), "job_id")


def job_outcomes(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("flow_count").alias("flows"))


def bundle(
    alerts: DataFrame, audit: DataFrame, start_us: int, end_us: int, kind: str = "security", top_n: int = 10
) -> dict[str, DataFrame]:
    """All tables of one report; each is lazy and shares the period filter."""
    a = in_period(alerts, start_us, end_us)
    out = {
        "severity": severity_breakdown(a),
        "attack_types": top_attack_types(a, top_n),
        "sources": top_sources(a, top_n),
        "timeline": daily_timeline(a),
        "engines": engine_stats(a),
        "confidence": average_confidence(a),
        "peak_hour": peak_hour(a),
        "resolution": resolution_rate(a),
    }
    if kind == "compliance":
        out["compliance"] = compliance(a, in_period(audit, start_us, end_us))
    if kind == "analytics":
        out["engine_share"] = engine_share(a)
    return out


def bundle_long(tables: dict[str, DataFrame]) -> DataFrame:
    """A report as one table (section, name, value)."""
    parts = []
    for section, df in tables.items():
        label = [c for c, t in df.dtypes if t == "string"][:1]
        values = [c for c, t in df.dtypes if t not in ("string",)]
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in values])
        item = F.col(label[0]) if label else F.lit("")
        parts.append(
            df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(pairs).alias("p")).select(
                "section", "item", "p.name", "p.value"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
