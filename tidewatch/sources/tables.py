"""CSV and rule-file scans, partitioned tables, exports, idempotent inserts."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.rules import parse_rules

EXPORT_COLUMNS = [
    "alert_id", "detected_at", "severity", "attack_type", "confidence", "detected_by", "src_ip", "dst_ip",
    "src_port", "dst_port", "protocol", "status", "description",
]
RANGE_US = {"24h": 86_400_000_000, "7d": 7 * 86_400_000_000, "30d": 30 * 86_400_000_000}


def read_labelled_csv(
    spark: SparkSession, paths: Sequence[str], features: Sequence[str], label: str = "Label"
) -> DataFrame:
    """Labelled-flow CSV files whose headers differ in case, blanks and columns, also within a folder.

    One scan finds each file's first line; files with the same header are scanned
    together. A missing feature becomes 0.0, ``file`` keeps the file name.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    numbered = lines.filter("start = 0").withColumn("place", F.monotonically_increasing_id())
    heads = numbered.groupBy("path").agg(F.min_by("value", "place").alias("header")).groupBy("header").agg(F.collect_list("path").alias("paths"))
    by_header = {tuple(next(csv.reader([r["header"]]))): sorted(r["paths"]) for r in heads.collect()}  # one row per header
    parts = []
    for header, files in by_header.items():
        found = {h.strip().lower(): h for h in reversed(header)}
        raw = spark.read.option("header", True).csv(files)
        col = lambda name: F.col(f"`{found[name.lower()]}`")  # noqa: B023, E731
        values = [
            (col(f).try_cast("double") if f.lower() in found else F.lit(0.0)).alias(f) for f in features
        ]
        parts.append(raw.select(F.col("_metadata.file_name").alias("file"), *values, col(label).alias("raw_label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_rule_lines(spark: SparkSession, directory: str) -> DataFrame:
    """All lines of ``*.rules`` files in (file name, line) order; category from the stem."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.rules").text(directory)
    return number_rule_lines(
        text.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    )


def number_rule_lines(files: DataFrame) -> DataFrame:
    """(file, content) to numbered lines; rule files are small texts."""
    lines = files.select("file", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line", "raw"))
    stem = F.initcap(F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), "_", " "))
    return ordered.positions(lines, [], "file", ["line"], "rule_order").withColumn("category", stem)


def read_rules(spark: SparkSession, directory: str) -> DataFrame:
    return parse_rules(read_rule_lines(spark, directory), "category")


def rules_per_file(lines: DataFrame) -> DataFrame:
    """Lines with a sid that are not comments."""
    t = F.trim("raw")
    return lines.groupBy("file").agg(F.count_if(t.contains("sid:") & ~t.startswith("#")).alias("rules"))


def with_month(df: DataFrame, t_us: str) -> DataFrame:
    ts = F.timestamp_micros(F.col(t_us))
    return df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))


def write_monthly(df: DataFrame, path: str, t_us: str, mode: str = "append", spread: int = 16) -> None:
    """Monthly folders. A month is written by up to ``spread`` tasks, so a month that
    holds much of the table is not one task, and each task writes few files."""
    salt = F.pmod(F.xxhash64(F.col(t_us)), F.lit(spread))
    (
        with_month(df, t_us)
        .repartition("year", "month", salt)
        .sortWithinPartitions("year", "month", t_us)
        .write.mode(mode).partitionBy("year", "month").parquet(path)
    )


def read_monthly(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Months first..last; the condition is on the partition columns and prunes folders."""
    at = F.col("year") * 12 + F.col("month")
    lo, hi = first[0] * 12 + first[1], last[0] * 12 + last[1]
    years = F.col("year").between(first[0], last[0])
    return spark.read.parquet(path).filter(years & at.between(lo, hi))


def _export(alerts: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return alerts.withColumns(
        {
            "detected_at": F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
            "confidence": F.round("confidence", 4),
            "src_port": blank("src_port"),
            "dst_port": blank("dst_port"),
            "protocol": blank("protocol"),
            "description": F.regexp_replace(blank("description"), "\n", " "),
        }
    )


def export_recent(
    alerts: DataFrame, now_us: int, range_: str = "7d", severity: str | None = None, attack_type: str | None = None,
    limit: int = 10_000,
) -> DataFrame:
    """The newest alerts of a range, at most ``limit`` rows (the feature of this export)."""
    a = alerts.filter(F.col("t_us") >= now_us - RANGE_US[range_])
    if severity:
        a = a.filter(F.col("severity") == severity.upper())
    if attack_type:
        a = a.filter(F.col("attack_type") == attack_type)
    newest = a.orderBy(F.col("t_us").desc(), "alert_id").limit(limit)
    return _export(newest).select(*EXPORT_COLUMNS)


def export_period(alerts: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """All alerts of a period, newest first, with the rule."""
    a = alerts.filter(F.col("t_us").between(start_us, end_us)).orderBy(F.col("t_us").desc(), "alert_id")
    return _export(a).select(*EXPORT_COLUMNS, "rule_id")


def write_csv(df: DataFrame, path: str) -> None:
    keep = {"header": True, "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**keep).csv(path)


def new_rows(batch: DataFrame, existing: DataFrame, key: str = "alert_id", order: Column | None = None) -> DataFrame:
    """Rows of a batch that are not stored yet, one per key: a replay inserts nothing."""
    order = order if order is not None else F.struct(*[c for c in batch.columns if c != key])
    one = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return one.join(existing.select(key), key, "left_anti")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
