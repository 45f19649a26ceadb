"""Duplicate suppression, correlation groups, attack chains, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import anchored, ordered, skew
from tidewatch.session import cut_lineage

DEDUP_US = 60_000_000
GROUP_US = 600_000_000
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
DEDUP_KEY = ["src_ip", "dst_ip", "attack_type"]


def severity_rank(c: Column) -> Column:
    out = F.lit(1)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def rank_severity(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), c)


def suppressions(events: DataFrame, window_us: int = DEDUP_US, row_id: str = "event_id") -> DataFrame:
    """Every event with the anchor of its duplicate window and ``opens``."""
    return anchored.anchored_windows(events, DEDUP_KEY, "t_us", window_us, row_id)


def deduplicate(events: DataFrame, window_us: int = DEDUP_US, row_id: str = "event_id") -> DataFrame:
    """One row per duplicate window: the event that opened it and ``dup_count``.

    The window collapses map-side (a count and the one opening row), so a flood of
    duplicates is small before it is shuffled.
    """
    marked = suppressions(events, window_us, row_id)
    return (
        marked.groupBy(*DEDUP_KEY, "anchor")
        .agg(
            (F.count(F.lit(1)) - 1).alias("dup_count"),
            F.max(F.when(F.col("opens"), F.struct(*events.columns))).alias("e"),
        )
        .select("e.*", "dup_count")
    )


def group(alerts: DataFrame, window_us: int = GROUP_US, row_id: str = "event_id") -> DataFrame:
    """Correlation group per source: anchored windows over emitted alerts."""
    out = anchored.anchored_windows(alerts, ["src_ip"], "t_us", window_us, row_id)
    return (
        out.withColumn("group_id", F.md5(F.concat_ws("|", "src_ip", F.col("anchor").cast("string"))))
        .withColumnRenamed("opens", "is_new_group")
        .withColumnRenamed("anchor", "group_start_us")
    )


def chains(grouped: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Attack types and top severity so far in the group, for every alert.

    Only the first appearance of each (type, severity) per group is needed: a few
    rows per group, joined back, instead of a running window over the group.
    """
    now = F.struct("t_us", row_id)
    firsts = grouped.groupBy("group_id", "attack_type", severity_rank(F.col("severity")).alias("rank")).agg(
        F.min(F.struct(F.col("t_us").alias("t_us"), F.col(row_id).alias(row_id))).alias("first")
    )
    seen = firsts.groupBy("group_id").agg(F.collect_list(F.struct("first", "attack_type", "rank")).alias("seen"))
    joined = skew.salted_join(grouped, seen, ["group_id"])
    past = F.filter("seen", lambda s: s["first"] <= now)
    types = F.array_sort(F.array_distinct(F.transform(past, lambda s: s["attack_type"])))
    top = F.array_max(F.transform(past, lambda s: s["rank"]))
    return (
        joined.withColumn("chain_attack_types", types)
        .withColumn("composite_severity", rank_severity(top))
        .withColumn("attack_chain", F.size("chain_attack_types") >= 2)
        .drop("seen")
    )


def correlate(
    events: DataFrame, dedup_us: int = DEDUP_US, group_us: int = GROUP_US, row_id: str = "event_id"
) -> DataFrame:
    """Deduplicate, group, and mark chains.

    Each step reads its input more than once and keeps only part of it, so the smaller
    tables in between are written out once instead of being computed again.
    """
    emitted = cut_lineage(deduplicate(events, dedup_us, row_id), "emitted")
    return chains(cut_lineage(group(emitted, group_us, row_id), "grouped"), row_id)


def group_summary(grouped: DataFrame) -> DataFrame:
    """Final severity, size, chain flag and span of each group."""
    return grouped.groupBy("group_id", "src_ip").agg(
        rank_severity(F.max(severity_rank(F.col("severity")))).alias("composite_severity"),
        F.count(F.lit(1)).alias("members"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"),
        F.min("t_us").alias("first_seen_us"),
        F.max("t_us").alias("last_seen_us"),
    ).withColumn("attack_chain", F.size("attack_types") >= 2)


def counters(
    marked: DataFrame, grouped: DataFrame, at_us: int, dedup_us: int = DEDUP_US, group_us: int = GROUP_US
) -> DataFrame:
    """Received / suppressed / emitted / chains, and state alive or expired at a time."""
    alive = lambda c, w: (F.col(c) <= at_us) & (at_us - F.col(c) <= w)
    gone = lambda c, w: at_us - F.col(c) > w
    first = F.col("opens")
    e = marked.agg(
        F.count(F.lit(1)).alias("total_received"),
        F.count_if(~first).alias("total_suppressed"),
        F.count_if(first).alias("total_emitted"),
        F.count_if(first & alive("anchor", dedup_us)).alias("active_dedup_slots"),
        F.count_if(first & gone("anchor", dedup_us)).alias("evicted_dedup"),
    )
    per_group = grouped.groupBy("group_id").agg(
        F.min("group_start_us").alias("g"), F.min("attack_type").alias("a"), F.max("attack_type").alias("b")
    )
    g = per_group.agg(
        F.count_if(F.col("a") != F.col("b")).alias("chain_flags_raised"),
        F.count_if(alive("g", group_us)).alias("active_correlation_groups"),
        F.count_if(gone("g", group_us)).alias("evicted_groups"),
    )
    return e.crossJoin(g)


def links(alerts: DataFrame, window_us: int = GROUP_US, chunk_us: int = 300_000_000) -> DataFrame:
    """Related alerts as a chain of neighbours.

    Each alert points to the alert just before it from the same source, and to the
    one just before it against the same target from another source, if at most
    ``window_us`` older. n alerts give at most 2n links; every pair inside a window
    is reachable along them, without writing n^2 rows.
    """
    a = alerts.select("alert_id", "src_ip", "dst_ip", "attack_type", "t_us").withColumn(
        "chunk", ordered.time_chunk("t_us", chunk_us)
    )
    cols = ["t_us", "alert_id", "src_ip", "dst_ip", "attack_type"]
    near = (F.col("t_us") - F.col("prev_t_us")).between(0, window_us)

    def neighbours(key):
        p = ordered.previous(a, [key], "chunk", ["t_us", "alert_id"], cols)
        return p.filter(near)

    same_source = F.when(F.col("attack_type") != F.col("prev_attack_type"), "MULTI_STAGE").when(
        F.col("dst_ip") == F.col("prev_dst_ip"), "TEMPORAL_SEQUENCE"
    ).otherwise("SAME_SOURCE")
    by_src = neighbours("src_ip").select("alert_id", F.col("prev_alert_id").alias("related_id"), same_source.alias("relation"))
    by_dst = neighbours("dst_ip").filter("src_ip <> prev_src_ip").select(
        "alert_id", F.col("prev_alert_id").alias("related_id"), F.lit("SAME_TARGET").alias("relation")
    )
    return by_src.unionByName(by_dst)


def coordinated(events: DataFrame, window_us: int = GROUP_US, sources: int = 3) -> DataFrame:
    """(target, type, tumbling window) hit by at least ``sources`` distinct sources."""
    slot = F.floor(F.col("t_us") / window_us).cast("long") * window_us
    one = events.groupBy("dst_ip", "attack_type", slot.alias("window_us"), "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return (
        one.groupBy("dst_ip", "attack_type", "window_us")
        .agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("events"))
        .filter(F.col("sources") >= sources)
    )
