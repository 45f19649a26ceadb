"""Packets to bidirectional flows and their 41 features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import network
from tidewatch.operators import ordered
from tidewatch.session import cut_lineage

IDLE_US = 60_000_000
CHUNK_US = 300_000_000
HOT_ROWS = 1_000_000

# Feature names in vector order.
FEATURES = [
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "total_length_fwd_packets",
    "total_length_bwd_packets",
    "fwd_packet_length_max",
    "fwd_packet_length_min",
    "fwd_packet_length_mean",
    "fwd_packet_length_std",
    "bwd_packet_length_max",
    "bwd_packet_length_min",
    "bwd_packet_length_mean",
    "bwd_packet_length_std",
    "flow_bytes_per_sec",
    "flow_packets_per_sec",
    "fwd_iat_total",
    "fwd_iat_mean",
    "fwd_iat_std",
    "fwd_iat_max",
    "fwd_iat_min",
    "bwd_iat_total",
    "bwd_iat_mean",
    "bwd_iat_std",
    "bwd_iat_max",
    "bwd_iat_min",
    "fin_flag_count",
    "syn_flag_count",
    "rst_flag_count",
    "psh_flag_count",
    "ack_flag_count",
    "urg_flag_count",
    "down_up_ratio",
    "average_packet_size",
    "avg_fwd_segment_size",
    "avg_bwd_segment_size",
    "fwd_header_length",
    "bwd_header_length",
    "fwd_packets_per_sec",
    "bwd_packets_per_sec",
    "min_packet_length",
    "max_packet_length",
]


def with_flags(packets: DataFrame) -> DataFrame:
    """Flag text and booleans, header and payload lengths."""
    text = F.when(F.col("protocol") == "TCP", network.flag_text(F.col("flag_bits")))
    out = packets.withColumn("tcp_flags", text)
    return out.withColumns(
        {
            **network.flag_booleans(F.col("tcp_flags")),
            "header_length": F.lit(20),
            "payload_length": F.coalesce(F.octet_length("payload"), F.lit(0)),
        }
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Canonical 5-tuple: the side with the smaller (address text, port) first.

    Packets without addresses cannot belong to a flow and are left out.
    """
    packets = packets.filter("src_ip IS NOT NULL AND dst_ip IS NOT NULL")
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    a = network.endpoint(F.col("src_ip"), F.col("src_port"))
    b = network.endpoint(F.col("dst_ip"), F.col("dst_port"))
    forward = src <= dst
    return packets.withColumn("is_forward", forward).withColumn(
        "flow_key",
        F.concat_ws(
            "-", F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a), "protocol"
        ),
    )


def sessionize(
    packets: DataFrame, idle_us: int = IDLE_US, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Give each packet its flow start (time, id) and the gap to the packet before
    it in the same flow and direction.

    A flow ends with a TCP packet carrying FIN or RST, that packet included, or when
    the next packet is ``idle_us`` or more later. One key may hold any share of the
    table: windows run per (key, time slice), and what crosses a slice border (the
    last packet, the last packet per direction, the last flow start) comes from a
    summary of one row per slice.
    """
    p = packets if "flow_key" in packets.columns else with_flow_key(packets)
    p = p.withColumn("chunk", ordered.time_chunk("t_us", chunk_us)).withColumn(
        "ends", (F.col("protocol") == "TCP") & (F.col("flag_fin") | F.col("flag_rst"))
    )
    keys, slot = ["flow_key"], ["flow_key", "chunk"]
    here = F.struct("t_us", "packet_id")
    fwd, bwd = F.when(F.col("is_forward"), here), F.when(~F.col("is_forward"), here)

    earlier = ordered.before(keys, "chunk")
    carried = (
        p.groupBy(*slot)
        .agg(
            F.max(F.struct("t_us", "packet_id", "ends")).alias("tail"),
            F.max(fwd).alias("tail_fwd"),
            F.max(bwd).alias("tail_bwd"),
        )
        .select(
            *slot,
            F.last("tail").over(earlier).alias("tail"),
            F.max("tail_fwd").over(earlier).alias("tail_fwd"),
            F.max("tail_bwd").over(earlier).alias("tail_bwd"),
        )
    )
    w = ordered.within(keys, "chunk", ["t_us", "packet_id"])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    last_t = F.coalesce(F.lag("t_us").over(w), F.col("tail.t_us"))
    last_ends = F.coalesce(F.lag("ends").over(w), F.col("tail.ends"))
    starts = last_t.isNull() | last_ends | (F.col("t_us") - last_t >= idle_us)
    same_way = F.when(
        F.col("is_forward"), F.coalesce(F.last(fwd, True).over(up_to), F.col("tail_fwd"))
    ).otherwise(F.coalesce(F.last(bwd, True).over(up_to), F.col("tail_bwd")))
    marked = p.join(carried, slot).select(
        *p.columns, starts.alias("starts"), same_way.alias("same_way")
    )
    opened = F.when(F.col("starts"), here)
    open_before = (
        marked.groupBy(*slot)
        .agg(F.max(opened).alias("opened"))
        .select(*slot, F.max("opened").over(earlier).alias("open_before"))
    )
    start = F.coalesce(F.last(opened, True).over(so_far), F.col("open_before"))
    return (
        marked.join(open_before, slot)
        .withColumn("flow_start", start)
        .withColumn(
            "iat_us",
            F.when(
                F.col("same_way") >= F.col("flow_start"), F.col("t_us") - F.col("same_way.t_us")
            ),
        )
        .drop("chunk", "ends", "starts", "same_way", "open_before")
    )


# Partial statistics of a value: rows, sum, mean, sum of squared distances from the mean,
# least, greatest. Pieces of one flow merge from these without going back to packets.


def _piece(name: str, value: Column) -> list[Column]:
    n = F.count(value)
    return [
        n.alias(f"{name}_n"),
        F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_sum"),
        (n * F.coalesce(F.var_pop(value), F.lit(0.0))).alias(f"{name}_m2"),
        F.min(value).alias(f"{name}_min"),
        F.max(value).alias(f"{name}_max"),
    ]


def _merge(name: str, link: str | None = None) -> list[Column]:
    """Merge pieces; ``link`` is one more value per piece (the gap to the piece before)."""
    n, total = F.col(f"{name}_n"), F.col(f"{name}_sum")
    square = F.when(n > 0, F.col(f"{name}_m2") + total.cast("double") * total / n).otherwise(0.0)
    lo, hi, rows, both = F.min(f"{name}_min"), F.max(f"{name}_max"), F.sum(n), F.sum(total)
    squares = F.sum(square)
    if link:
        x = F.col(link)
        rows, both = rows + F.count(x), both + F.coalesce(F.sum(x), F.lit(0))
        squares = squares + F.coalesce(F.sum(x.cast("double") * x), F.lit(0.0))
        lo, hi = F.least(lo, F.min(x)), F.greatest(hi, F.max(x))
    m2 = F.when(rows > 1, F.greatest(squares - both.cast("double") * both / rows, F.lit(0.0))).otherwise(0.0)
    return [rows.alias(f"{name}_n"), both.alias(f"{name}_sum"), m2.alias(f"{name}_m2"), lo.alias(f"{name}_min"), hi.alias(f"{name}_max")]


SIDES = ("fwd", "bwd")
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg")


def flow_pieces(
    packets: DataFrame, idle_us: int = IDLE_US, chunk_us: int = CHUNK_US, least: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Aggregates per (key, time slice, flow inside the slice).

    One shuffle by (key, slice); the aggregation runs in the same partitions. ``seq`` 0
    may continue a flow of an earlier slice, higher ones start inside the slice. Only
    keys with more than ``hot_rows`` packets are sliced (0 slices all without counting).
    """
    p = packets if "flow_key" in packets.columns else with_flow_key(packets)
    chunk = ordered.time_chunk("t_us", chunk_us)
    p = ordered.slice_hot_keys(p, ["flow_key"], chunk, hot_rows) if hot_rows else p.withColumn("chunk", chunk)
    p = p.withColumn("ends", (F.col("protocol") == "TCP") & (F.col("flag_fin") | F.col("flag_rst")))
    keep = ["flow_key", "chunk", "t_us", "packet_id", "is_forward", "length", "header_length", "flag_bits", "ends"]
    p = p.select(*keep, *[f"flag_{f}" for f in FLAGS], *least).repartition("flow_key", "chunk")
    w = ordered.within(["flow_key"], "chunk", ["t_us", "packet_id"])
    so_far, up_to = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("t_us") - F.lag("t_us").over(w)
    cut = F.coalesce((gap >= idle_us) | F.lag("ends").over(w), F.lit(False))
    p = p.withColumn("cut", cut).withColumn("first", cut | (F.row_number().over(w) == 1))
    p = p.withColumn("seq", F.sum(F.col("cut").cast("long")).over(so_far))
    fwd = F.col("is_forward")
    here = F.struct("t_us", "seq")
    before = F.when(fwd, F.last(F.when(fwd, here), True).over(up_to)).otherwise(
        F.last(F.when(~fwd, here), True).over(up_to)
    )
    p = p.withColumn("before", before).withColumn(
        "iat", F.when(F.col("before.seq") == F.col("seq"), F.col("t_us") - F.col("before.t_us"))
    )
    aggs = [
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"),
        F.max(F.when(F.col("first"), F.col("packet_id"))).alias("first_packet_id"),
        F.max("ends").alias("ends"), F.sum("length").alias("byte_count"), F.bit_or("flag_bits").alias("flag_union"),
        *[F.count_if(f"flag_{f}").alias(f"{f}_flag_count") for f in FLAGS],
        *[F.min(c).alias(c) for c in least],
    ]
    for side, mine in zip(SIDES, (fwd, ~fwd)):
        aggs += _piece(f"{side}_len", F.when(mine, F.col("length")))
        aggs += _piece(f"{side}_iat", F.when(mine, F.col("iat")))
        aggs += [
            F.coalesce(F.sum(F.when(mine, F.col("header_length"))), F.lit(0)).alias(f"{side}_header"),
            F.min(F.when(mine, F.col("t_us"))).alias(f"{side}_first"),
            F.max(F.when(mine, F.col("t_us"))).alias(f"{side}_last"),
        ]
    return p.groupBy("flow_key", "chunk", "seq").agg(*aggs)


def _merged(edges: DataFrame, idle_us: int, least: Sequence[str]) -> DataFrame:
    """Join the pieces at slice borders. There are at most two per (key, slice), so
    the per-key order here is over slices, not packets."""
    w = Window.partitionBy("flow_key").orderBy("chunk", "seq")
    opens = (
        F.lag("end_us").over(w).isNull() | (F.col("seq") > 0) | F.lag("ends").over(w)
        | (F.col("start_us") - F.lag("end_us").over(w) >= idle_us)
    )
    e = edges.withColumn("opens", opens).withColumn(
        "flow_no", F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    inner = Window.partitionBy("flow_key", "flow_no").orderBy("chunk", "seq").rowsBetween(Window.unboundedPreceding, -1)
    for side in SIDES:
        e = e.withColumn(f"{side}_link", F.col(f"{side}_first") - F.max(f"{side}_last").over(inner))
    aggs = [
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.max(F.when(F.col("opens"), F.col("first_packet_id"))).alias("first_packet_id"),
        F.sum("byte_count").alias("byte_count"), F.bit_or("flag_union").alias("flag_union"),
        *[F.sum(f"{f}_flag_count").alias(f"{f}_flag_count") for f in FLAGS],
        *[F.min(c).alias(c) for c in least],
    ]
    for side in SIDES:
        aggs += _merge(f"{side}_len") + _merge(f"{side}_iat", f"{side}_link")
        aggs.append(F.sum(f"{side}_header").alias(f"{side}_header"))
    return e.groupBy("flow_key", "flow_no").agg(*aggs).drop("flow_no")


def _vector_columns() -> dict[str, Column]:
    """The 41 features from merged statistics."""
    zero = F.lit(0.0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(zero)
    c = F.col
    dur = (c("end_us") - c("start_us")) / 1e6
    out = {"flow_duration": dur}
    for side in SIDES:
        n, total = c(f"{side}_len_n").cast("double"), c(f"{side}_len_sum").cast("double")
        gaps = c(f"{side}_iat_n").cast("double")
        out |= {
            f"total_{side}_packets": n,
            f"total_length_{side}_packets": total,
            f"{side}_packet_length_max": F.coalesce(c(f"{side}_len_max").cast("double"), zero),
            f"{side}_packet_length_min": F.coalesce(c(f"{side}_len_min").cast("double"), zero),
            f"{side}_packet_length_mean": ratio(total, n),
            f"{side}_packet_length_std": F.sqrt(ratio(c(f"{side}_len_m2"), n)),
            f"{side}_iat_total": c(f"{side}_iat_sum") / 1e6,
            f"{side}_iat_mean": ratio(c(f"{side}_iat_sum"), gaps) / 1e6,
            f"{side}_iat_std": F.sqrt(ratio(c(f"{side}_iat_m2"), gaps)) / 1e6,
            f"{side}_iat_max": F.coalesce(c(f"{side}_iat_max") / 1e6, zero),
            f"{side}_iat_min": F.coalesce(c(f"{side}_iat_min") / 1e6, zero),
            f"avg_{side}_segment_size": ratio(total, n),
            f"{side}_header_length": c(f"{side}_header").cast("double"),
            f"{side}_packets_per_sec": ratio(n, dur),
        }
    pkts = (c("fwd_len_n") + c("bwd_len_n")).cast("double")
    out |= {f"{f}_flag_count": c(f"{f}_flag_count").cast("double") for f in FLAGS}
    out |= {
        "flow_bytes_per_sec": ratio(c("byte_count"), dur),
        "flow_packets_per_sec": ratio(pkts, dur),
        "down_up_ratio": ratio(c("bwd_len_sum").cast("double"), c("fwd_len_sum")),
        "average_packet_size": ratio(c("byte_count"), pkts),
        "min_packet_length": F.least("fwd_len_min", "bwd_len_min").cast("double"),
        "max_packet_length": F.greatest("fwd_len_max", "bwd_len_max").cast("double"),
    }
    # a flow with an unusable value keeps its row with zeros instead of failing
    return {f: F.coalesce(F.nanvl(out[f], zero), zero) for f in FEATURES}


def flows(
    packets: DataFrame, idle_us: int = IDLE_US, chunk_us: int = CHUNK_US, least: Sequence[str] = (),
    hot_rows: int = HOT_ROWS, write_pieces: bool = False,
) -> DataFrame:
    """One row per flow: identity, start, end, the 41 features, and the least value of
    each column in ``least``.

    Packets are shuffled once, by (key, time slice). Flows that begin and end inside a
    slice are finished there; only pieces at slice borders are merged per key. Both
    branches read the pieces; with ``write_pieces`` these are stored first, so that large
    inputs are sorted once.
    """
    pieces = flow_pieces(packets, idle_us, chunk_us, least, hot_rows)
    # marked before they are stored: here they still lie by (key, slice)
    slot = Window.partitionBy("flow_key", "chunk").orderBy("seq")
    pieces = pieces.withColumn("edge", (F.col("seq") == 0) | F.lead("seq").over(slot).isNull())
    if write_pieces:
        pieces = cut_lineage(pieces, "pieces")
    edges = _merged(pieces.filter("edge"), idle_us, least)
    whole = pieces.filter("NOT edge").select(*edges.columns).unionByName(edges)
    part = F.split("flow_key", "-")
    port = lambda i: F.substring_index(part[i], ":", -1)
    address = lambda i: F.left(part[i], F.length(part[i]) - F.length(port(i)) - 1)
    return whole.select(
        F.concat_ws("@", "flow_key", "first_packet_id").alias("flow_id"),
        "flow_key",
        address(0).alias("src_ip"),
        address(1).alias("dst_ip"),
        port(0).try_cast("int").alias("src_port"),
        port(1).try_cast("int").alias("dst_port"),
        part[2].alias("protocol"),
        "start_us", "end_us", "first_packet_id",
        (F.col("fwd_len_n") + F.col("bwd_len_n")).alias("pkt_count"),
        "byte_count", "flag_union",
        *[v.alias(k) for k, v in _vector_columns().items()],
        *least,
    )


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*FEATURES))


def vector_to_map(vector: Column) -> Column:
    """Named map of a 41-vector; any other size is an error."""
    names = F.array(*[F.lit(f) for f in FEATURES])
    checked = F.when(F.size(vector) == len(FEATURES), vector).otherwise(
        F.raise_error(F.concat(F.lit("expected 41 features, got "), F.size(vector).cast("string"))).cast("array<double>")
    )
    return F.map_from_arrays(names, checked)


def features_json(df: DataFrame) -> DataFrame:
    """The feature vector as one JSON object per flow."""
    return df.withColumn("feature_vector", F.to_json(F.struct(*FEATURES)))


def json_contains(column: str, **wanted: float) -> Column:
    """All named values occur in a JSON object."""
    cond = F.lit(True)
    for k, v in wanted.items():
        cond = cond & (F.get_json_object(column, f"$.{k}").try_cast("double") == F.lit(float(v)))
    return cond


def capture_counters(packets: DataFrame, flow_table: DataFrame) -> DataFrame:
    """Captured / usable / malformed packets, flows and rates as one row."""
    p = packets.agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if(F.col("src_ip").isNotNull()).alias("enqueued"),
        F.count_if(F.col("src_ip").isNull()).alias("malformed"),
        ((F.max("t_us") - F.min("t_us")) / 1e6).alias("seconds"),
    )
    f = flow_table.agg(F.count(F.lit(1)).alias("flows"), F.sum("pkt_count").alias("flow_packets"))
    return p.crossJoin(f).withColumn(
        "flows_per_sec",
        F.when(F.col("seconds") > 0, F.col("flows") / F.col("seconds")).otherwise(F.lit(0.0)),
    )
