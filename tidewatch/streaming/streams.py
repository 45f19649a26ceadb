"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import correlate
from tidewatch.operators import flows as flow_ops
from tidewatch.operators import rules as rule_ops
from tidewatch.session import ROCKSDB, scratch_path
from tidewatch.sources import tables
from tidewatch.streaming import processors as pr

# how late a row may be; later ones are dropped and counted in the query's progress
# (stateOperators.numRowsDroppedByWatermark), or given out as rows of their own where that is asked for
DELAY = "10 seconds"


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """An append table as a stream; the source rate replaces bounded queues that drop."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_after(table: DataFrame, last_id: int, n: int, column: str = "event_id") -> DataFrame:
    """The next at most ``n`` entries after an id, in id order (one page; ``n`` is the feature)."""
    return table.filter(F.col(column) > last_id).orderBy(column).limit(n)


def stream_after(stream: DataFrame, last_id: int, column: str = "event_id") -> DataFrame:
    """Everything after an id, as it comes; the stream's checkpoint keeps the place across restarts."""
    return stream.filter(F.col(column) > last_id)


def timed(df: DataFrame, delay: str = DELAY) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)


def _stateful(df: DataFrame, keys: list[str], processor: pr.InOrder, late: bool = False, goes_on: bool = False) -> DataFrame:
    """The processor's rows. With ``late`` they have the columns of LATE too, and nothing is dropped: without its
    event-time column Spark lets late rows pass to the processor. With ``goes_on`` another processor may follow."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = processor.schema
    if late:
        processor.gives_late = True
        df, schema = df.drop("ts"), f"{schema}, {pr.LATE}"
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime", eventTimeColumnName="ts" if goes_on else "")


def flow_stream(packets: DataFrame, idle_us: int = flow_ops.IDLE_US, delay: str = DELAY) -> DataFrame:
    # a row without an id moves the watermark on and must not be left out for want of addresses
    no_id = F.col("packet_id").isNull()
    packets = packets.withColumns({c: F.when(no_id, "-").otherwise(F.col(c)) for c in ("src_ip", "dst_ip")})
    p = flow_ops.with_flow_key(flow_ops.with_flags(packets))
    return _stateful(timed(p, delay), ["flow_key"], pr.Flows(idle_us))


def duplicate_stream(events: DataFrame, width_us: int = correlate.DEDUP_US, delay: str = DELAY, late: bool = False) -> DataFrame:
    """Duplicate windows; with ``late`` also a row for each event that comes behind the watermark (see ``split_late``)."""
    return _stateful(timed(events, delay), correlate.DEDUP_KEY, pr.DuplicateWindows(width_us), late)


def split_late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows (t_us, id)) of a table that a stream with ``late`` wrote."""
    late = [c.split()[0] for c in pr.LATE.split(", ")]
    return rows.filter(F.col(late[1]).isNull()).drop(*late), rows.filter(F.col(late[1]).isNotNull()).selectExpr(f"{late[0]} AS t_us", f"{late[1]} AS id")


def group_stream(events: DataFrame, dedup_us: int = correlate.DEDUP_US, group_us: int = correlate.GROUP_US, delay: str = DELAY) -> DataFrame:
    """Events (event_id, t_us, src_ip, dst_ip, attack_type, severity) to alerts with the start of their correlation group.

    Kinds of rows: ``alert``, ``closed`` (a duplicate window ended, with its count), ``group_closed``.
    """
    emitted = _stateful(timed(events, delay), correlate.DEDUP_KEY, pr.EmittedAlerts(dedup_us), goes_on=True)
    return _stateful(emitted, ["src_ip"], pr.CorrelationGroups(group_us), goes_on=True)


def chain_stream(events: DataFrame, dedup_us: int = correlate.DEDUP_US, group_us: int = correlate.GROUP_US, delay: str = DELAY) -> DataFrame:
    """Duplicates, groups and chains, one stateful operator behind the other."""
    return _stateful(group_stream(events, dedup_us, group_us, delay), ["src_ip", "group_start_us"], pr.AttackChains())


def correlation_counters(changes: DataFrame, at_us: int) -> DataFrame:
    """Counters at a time, from what ``chain_stream`` gave: windows and groups open at it, and those whose timers had run out."""
    is_ = lambda kind: F.col("kind") == kind
    gone, begun = F.col("t_us") < at_us, F.col("t_us") <= at_us
    count = F.count_if
    return changes.agg(
        F.sum(F.when(is_("closed"), F.col("dup_count")).otherwise(0)).alias("total_suppressed"),
        count(is_("alert")).alias("total_emitted"),
        count(is_("alert") & begun).alias("begun"),
        count(is_("closed") & gone).alias("evicted_dedup"),
        count(is_("group_closed") & F.col("attack_chain")).alias("chain_flags_raised"),
        count(F.col("is_new_group") & begun).alias("groups_begun"),
        count(is_("group_closed") & gone).alias("evicted_groups"),
    ).select(
        (F.col("total_emitted") + F.col("total_suppressed")).alias("total_received"), "total_suppressed", "total_emitted",
        (F.col("begun") - F.col("evicted_dedup")).alias("active_dedup_slots"), "evicted_dedup", "chain_flags_raised",
        (F.col("groups_begun") - F.col("evicted_groups")).alias("active_correlation_groups"), "evicted_groups",
    )


def rate_stream(matches: DataFrame, rules: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rate alerts from a stream of packet matches (rule_id, t_us, packet_id, src_ip, dst_ip) and the table of rules."""
    # a row without an id moves the watermark on and must not be lost in the join
    spec = rule_ops.thresholds(rules)
    tracked = F.when(F.col("threshold_track") == "by_dst", F.col("dst_ip")).otherwise(F.col("src_ip"))
    joined = timed(matches, delay).join(spec, "rule_id", "left").filter("threshold_type IS NOT NULL OR packet_id IS NULL")
    return _stateful(joined.withColumn("tracked", tracked), ["rule_id", "tracked"], pr.RateThresholds())


def recent_stream(
    flows: DataFrame, size: int = 10, keep_ms: int = 86_400_000, delay: str = DELAY
) -> DataFrame:
    """Expects src_ip, event_id, t_us, vector."""
    return _stateful(timed(flows, delay), ["src_ip"], pr.RecentVectors(size, keep_ms))


def workflow_stream(actions: DataFrame, delay: str = DELAY) -> DataFrame:
    return _stateful(timed(actions, delay), ["alert_id"], pr.Workflow())


def live_counters(alerts: DataFrame, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Alerts per window and severity."""
    w = F.window("ts", window)
    return timed(alerts, delay).groupBy(w, "severity").agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("window.start").alias("window_us"), "severity", "n"
    )


def to_table(df: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table until the source is drained."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def insert_stream(alerts: DataFrame, path: str, checkpoint: str, key: str = "alert_id"):
    """Append alerts that are not stored yet; a replayed batch inserts nothing.

    The table is kept by month (``t_us``), and a batch only reads the months it touches.
    """
    schema = tables.with_month(alerts, "t_us").schema
    alerts.sparkSession.createDataFrame([], schema).write.mode("append").partitionBy("year", "month").parquet(path)

    def insert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = tables.with_month(batch, "t_us")
        months = [tuple(r) for r in rows.select("year", "month").distinct().collect()]
        if not months:
            return
        at = F.col("year") * 12 + F.col("month")
        stored = spark.read.schema(schema).parquet(path).filter(at.isin([y * 12 + m for y, m in months]))
        tables.new_rows(rows, stored, key).write.mode("append").partitionBy("year", "month").parquet(path)

    return (
        alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(insert)
        .trigger(availableNow=True).start()
    )


def drained(df: DataFrame, name: str, start=to_table) -> DataFrame:
    """Run a stream over what is there now and return the table it wrote."""
    spark = df.sparkSession
    out, mark = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    start(df, out, mark).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


#: rows of a replayed file; a batch of a large table has as many files as that takes, each read by a task of its own
FILE_ROWS = 250_000


def replay(df: DataFrame, slices: int = 4, files: int = 4, end: bool = True, held: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Store a table as files in about event-time order and open it as a stream.

    Each slice of time is dealt to `files` files, or more if the table is large, and a row may come up to one slice late, so
    rows come out of order within and across micro-batches. Returns the stream and the delay
    that its watermark needs. ``end`` adds a last row of nulls, but for a time a year later:
    the end of the input, which lets everything that is open be finished. ``held`` are rows that
    come only after that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "slices")
    lo, hi, rows = df.agg(F.min("t_us"), F.max("t_us"), F.count(F.lit(1))).first()
    files = max(files, rows // (slices + 1) // FILE_ROWS)
    width = (hi - lo) // slices + 1
    plain = [c for c, t in df.dtypes if "<" not in t]
    late = F.pmod(F.xxhash64(*plain), F.lit(width))
    numbered = df.withColumn("__slice", F.floor((F.col("t_us") - lo + late) / width))
    for i in range(slices + 1):
        numbered.filter(F.col("__slice") == i).drop("__slice").repartition(files).write.mode("append").parquet(path)
    if end:
        last = [(F.lit(hi + 2 * width + 366 * 86_400_000_000) if c == "t_us" else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes]
        # as many files as a batch takes, so that held rows come in a batch of their own
        spark.range(0, files, 1, files if held is not None else 1).select(*last).write.mode("append").parquet(path)
    if held is not None:
        held.select(df.columns).repartition(files).write.mode("append").parquet(path)
    return open_stream(spark, path, df.schema, files), f"{2 * width // 1000 + 1} milliseconds"
