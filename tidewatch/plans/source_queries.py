"""Sources and sinks over the given tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.plans import adapters as ad
from tidewatch.plans import report_queries as rq
from tidewatch.plans import reports as rp
from tidewatch.plans.catalog import r, register, rounded
from tidewatch.plans.ml_queries import PC, confusion
from tidewatch.plans.rule_queries import PART_LINE, part_rule_lines
from tidewatch.session import scratch_path
from tidewatch.sources import captures, tables

A = ad.cte("alerts")


def _h(expr, digits):
    return f"lpad(hex(CAST({expr} AS BIGINT)), {digits}, '0')"


def _ip(c):
    return "concat(" + ", ".join(_h(f"split_part({c}, '.', {i})", 2) for i in range(1, 5)) + ")"


def frames(spark, sf):
    """Ethernet frames spelled out byte by byte from the packet table."""
    body = "hex(encode(coalesce(payload, ''), 'UTF-8'))"
    size = "octet_length(coalesce(payload, ''))"
    l4 = (
        f"CASE protocol WHEN 'TCP' THEN concat({_h('src_port', 4)}, {_h('dst_port', 4)}, repeat('0', 16), '50', "
        f"{_h('flag_bits', 2)}, repeat('0', 12)) WHEN 'UDP' THEN concat({_h('src_port', 4)}, {_h('dst_port', 4)}, "
        f"{_h(f'8 + {size}', 4)}, '0000') ELSE concat({_h('icmp_type', 2)}, repeat('0', 14)) END"
    )
    proto = "CASE protocol WHEN 'TCP' THEN '06' WHEN 'UDP' THEN '11' ELSE '01' END"
    head = f"CASE protocol WHEN 'TCP' THEN 40 ELSE 28 END + {size}"
    kind = "CASE WHEN packet_id % 23 = 0 THEN '0806' ELSE '0800' END"
    vlan = "CASE WHEN packet_id % 5 = 0 THEN '81000001' ELSE '' END"
    text = (
        f"concat(repeat('0', 24), {vlan}, {kind}, '4500', {_h(head, 4)}, repeat('0', 8), '40', {proto}, '0000', "
        f"{_ip('src_ip')}, {_ip('dst_ip')}, {l4}, {body})"
    )
    return ad.load(spark, sf, "packets").select(
        F.col("packet_id").alias("seq"), "t_us", F.expr(f"unhex({text})").alias("frame")
    )


DECODED_SQL = f"""{ad.cte("packets")}, decoded AS (SELECT packet_id AS seq, t_us, src_ip, dst_ip, src_port, dst_port, protocol,
 (CASE WHEN packet_id % 5 = 0 THEN 18 ELSE 14 END + CASE protocol WHEN 'TCP' THEN 40 ELSE 28 END + coalesce(strlen(payload), 0))::INT AS length,
 CASE WHEN protocol = 'TCP' THEN flag_bits END AS flag_bits, CASE WHEN protocol = 'ICMP' THEN icmp_type END AS icmp_type, coalesce(payload, '') AS payload
 FROM packets WHERE packet_id % 23 <> 0)"""


@register("src_decode_frames", f"WITH {DECODED_SQL} SELECT * FROM decoded")
def decode_frames(spark, sf):
    return captures.decode_frames(frames(spark, sf)).drop("frame").withColumn("payload", F.decode("payload", "UTF-8"))


@register(
    "src_capture_records",
    f"WITH {DECODED_SQL} SELECT seq // 1000 AS file, seq % 1000 AS seq, t_us, src_ip, dst_ip, length, payload FROM decoded",
)
def capture_records(spark, sf):
    """Frames packed into capture files of a thousand records, read back, decoded."""
    record = (
        f"concat({_h('t_us div 1000000', 8)}, {_h('t_us % 1000000', 8)}, {_h('octet_length(frame)', 8)}, "
        f"{_h('octet_length(frame)', 8)}, hex(frame))"
    )
    head = "concat('A1B2C3D4', '00020004', repeat('0', 16), '0000FFFF', '00000001')"
    files = (
        frames(spark, sf)
        .select(F.expr("seq div 1000").alias("file"), F.struct("seq", F.expr(record).alias("rec")).alias("x"))
        .groupBy("file").agg(F.sort_array(F.collect_list("x")).alias("l"))
        .select(
            F.col("file").cast("string").alias("path"),
            F.unhex(F.concat(F.expr(head), F.array_join(F.transform("l", lambda x: x["rec"]), ""))).alias("content"),
        )
    )
    d = captures.decode_frames(captures.split_captures(files))
    return d.select(
        F.col("path").cast("long").alias("file"), "seq", "t_us", "src_ip", "dst_ip", "length",
        F.decode("payload", "UTF-8").alias("payload"),
    )


@register(
    "src_capture_counts",
    f"WITH {ad.cte('packets')} SELECT count(*) AS captured, count(*) FILTER (packet_id % 23 <> 0) AS enqueued, count(*) FILTER (packet_id % 23 = 0) AS malformed FROM packets",
)
def capture_counts(spark, sf):
    return captures.capture_counts(frames(spark, sf))


@register(
    "src_labelled_csv",
    f"""WITH {ad.cte("labelled")} SELECT raw_label, count(*) AS n, {r("sum(x2)", "s2")}, count(*) FILTER (isinf(x0)) AS infinite,
 sum(CASE WHEN file IN ('day0', 'day1') THEN 0 ELSE coalesce(x1, 0) END) AS s1 FROM labelled GROUP BY raw_label""",
)
def labelled_csv(spark, sf):
    """Three headers, two of them in one folder, written as CSV and scanned as one table."""
    base = scratch_path(spark, "csv")
    d = ad.load(spark, sf, "labelled")
    keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    d.filter("file = 'day0'").selectExpr("x0 AS ` X0`", "x2 AS `X2 `", "raw_label AS ` Label`").write.options(**keep).csv(f"{base}/a")
    d.filter("file = 'day1'").selectExpr("raw_label AS Label", "x2", "x0").write.mode("append").options(**keep).csv(f"{base}/a")
    d.filter("file NOT IN ('day0', 'day1')").selectExpr("x0", "x1", "x2", "raw_label AS Label").write.options(**keep).csv(
        f"{base}/b"
    )
    got = tables.read_labelled_csv(spark, [f"{base}/a", f"{base}/b"], ["x0", "x1", "x2"])
    return rounded(
        got.groupBy("raw_label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("x2").alias("s2"),
            F.count_if(F.abs("x0") == float("inf")).alias("infinite"),
            F.coalesce(F.sum("x1"), F.lit(0.0)).alias("s1"),
        )
    )


@register(
    "src_rule_lines",
    f"""WITH l AS (SELECT 'dos_' || lpad((p_partkey // 50)::VARCHAR, 6, '0') || '.rules' AS file, p_partkey, {PART_LINE} AS raw FROM part)
SELECT (row_number() OVER (ORDER BY file, p_partkey) - 1) AS rule_order, file, (row_number() OVER (PARTITION BY file ORDER BY p_partkey) - 1)::INT AS line,
 raw, 'Dos ' || substr(file, 5, 6) AS category FROM l""",
)
def rule_lines(spark, sf):
    """Rule files of fifty lines as (file, text), numbered over all files in file and line order."""
    file = F.format_string("dos_%06d.rules", F.expr("p_partkey div 50"))
    part = ad.table(spark, sf, "part").select(file.alias("file"), F.struct("p_partkey", F.expr(PART_LINE).alias("raw")).alias("x"))
    text = part.groupBy("file").agg(F.sort_array(F.collect_list("x")).alias("l")).select(
        "file", F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("content")
    )
    return tables.number_rule_lines(text).select("rule_order", "file", "line", "raw", "category")


@register(
    "src_rules_per_file",
    """SELECT 'f' || p_size % 7 AS file, count(*) FILTER (p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 5 <> 0) AS rules FROM part GROUP BY 1""",
)
def rules_per_file(spark, sf):
    size = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("rule_order"), F.expr("concat('f', p_size % 7)").alias("file"))
    return tables.rules_per_file(part_rule_lines(spark, sf).join(size, "rule_order"))


@register(
    "src_monthly_tables",
    """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders
WHERE o_orderdate >= '1995-11-01' AND o_orderdate < '1997-03-01' GROUP BY ALL""",
)
def monthly_tables(spark, sf):
    path = scratch_path(spark, "monthly")
    o = ad.table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS created_us")
    tables.write_monthly(o, path, "created_us")
    got = tables.read_monthly(spark, path, (1995, 11), (1997, 2))
    return got.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))


_TEXT = "replace(coalesce(description, ''), chr(10), ' ') AS description"
_CSV = f"""alert_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS detected_at, severity, attack_type, {r("confidence")}, detected_by, src_ip, dst_ip,
 coalesce(src_port::VARCHAR, '') AS src_port, coalesce(dst_port::VARCHAR, '') AS dst_port, coalesce(protocol, '') AS protocol, status, {_TEXT}"""


@register(
    "src_export_recent",
    f"WITH {A}, n AS (SELECT * FROM alerts WHERE t_us >= {rp.micros(rq.datetime(2024, 1, 31))} - {tables.RANGE_US['7d']} AND severity = 'LOW' ORDER BY t_us DESC, alert_id LIMIT 10000) SELECT {_CSV} FROM n",
)
def export_recent(spark, sf):
    return tables.export_recent(ad.load(spark, sf, "alerts"), rq.NOW, "7d", "low")


@register("src_export_period", f"WITH {rq.A} SELECT {_CSV}, rule_id FROM a")
def export_period(spark, sf):
    """Written as CSV and read back."""
    path = scratch_path(spark, "export")
    tables.write_csv(tables.export_period(ad.load(spark, sf, "alerts"), rq.START, rq.END), path)
    schema = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in [*tables.EXPORT_COLUMNS, "rule_id"])
    got = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").schema(schema).csv(path)
    return got


@register(
    "src_insert_new",
    f"WITH {A} SELECT alert_id, t_us FROM alerts WHERE event_id % 3 <> 0",
)
def insert_new(spark, sf):
    """A batch replayed twice against a store that has a third of it."""
    a = ad.load(spark, sf, "alerts")
    fresh = tables.new_rows(a.unionByName(a), a.filter("event_id % 3 = 0"))
    return fresh.select("alert_id", "t_us")


@register("src_metrics_json", f"WITH {PC} SELECT class, {r('f1')}, support FROM pc")
def metrics_json(spark, sf):
    path = scratch_path(spark, "metrics")
    tables.write_metrics(metrics.per_class(confusion(spark, sf)).select("class", "f1", "support"), path)
    return rounded(spark.read.schema("class string, f1 double, support long").json(path))


@register(
    "rpt_history",
    f"""WITH {ad.cte("audit")} SELECT entity_id AS report_id, max(t_us) AS generated_us, count(*) AS n FROM audit GROUP BY entity_id ORDER BY generated_us DESC""",
)
def report_history(spark, sf):
    """Report runs appended to a table in two batches, listed newest first."""
    path = scratch_path(spark, "history")
    runs = ad.load(spark, sf, "audit").groupBy(F.col("entity_id").alias("report_id")).agg(
        F.max("t_us").alias("generated_us"), F.count(F.lit(1)).alias("n")
    )
    even = F.col("n") % 2 == 0
    for part in (runs.filter(even), runs.filter(~even)):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path).orderBy(F.col("generated_us").desc(), "report_id")
