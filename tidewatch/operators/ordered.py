"""Ordered per-key computations that never put one whole key into one task.

A window over (key) alone would sort a key that owns a third of the table in a
single task. Everything here works on (key, chunk) instead, where a chunk is a
deterministic slice of the ordering column (a time slice, a position slice, a hash
prefix). What a chunk needs from the chunks before it travels in a summary of one
row per (key, chunk), built with map-side partial aggregation. Only that summary is
scanned per key, and its length is bounded by the number of chunks, not by rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import skew
from tidewatch.session import cut_lineage


def before(keys: Sequence[str], chunk: str):
    """All chunks of the key before the current one."""
    return (
        Window.partitionBy(*keys)
        .orderBy(chunk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def within(keys: Sequence[str], chunk: str, order: Sequence[str | Column]):
    return Window.partitionBy(*keys, chunk).orderBy(*order)


def time_chunk(t_us: str | Column, width_us: int) -> Column:
    t = F.col(t_us) if isinstance(t_us, str) else t_us
    return F.floor(t / F.lit(width_us)).cast("long")


def slice_hot_keys(
    df: DataFrame, keys: Sequence[str], chunk: Column, hot_rows: int, name: str = "chunk"
) -> DataFrame:
    """Slice only keys with more than ``hot_rows`` rows; the rest stay in slice 0.

    Keys are counted first (map-side combined). There are at most rows / hot_rows hot
    ones; they are stored, and Spark broadcasts them if their bytes allow.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = cut_lineage(n.select(*keys, F.lit(True).alias("__hot")), "hot")
    return (
        df.join(hot, list(keys), "left")
        .withColumn(name, F.when(F.col("__hot"), chunk).otherwise(F.lit(0).cast("long")))
        .drop("__hot")
    )


#: Rows that one task puts in order; a range of them, so about this many.
SLICE_ROWS = 50_000


def sliced(df: DataFrame, by: Sequence[str | Column], name: str = "slice", rows: int = SLICE_ROWS) -> DataFrame:
    """The rows with the number of their slice: slices follow each other in the order of ``by`` and hold about ``rows`` rows each.

    A key in front of ``by`` spans as many slices as its rows need. The result is written, so that a slice stays
    the same when a task is repeated; ``df`` is read twice and best a stored table. Rows that are equal in
    all of ``by`` share a slice.
    """
    parts = max(1, -(-df.count() // rows))
    return cut_lineage(df.repartitionByRange(parts, *by).withColumn(name, F.spark_partition_id()), name)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``value`` replaced by the last one that is not null at or before the row, per key.

    Inside a slice by a window; what a slice needs from those before it is one value per key that crosses its border.
    """
    placed = sliced(df, [*keys, *order], "__slice", rows)
    upto = Window.partitionBy("__slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__in", F.last(value, ignorenulls=True).over(upto))
    tails = placed.groupBy("__slice", *keys).agg(F.max_by("__in", F.struct(*order)).alias("__tail"))
    into = F.last("__tail", ignorenulls=True).over(before(keys, "__slice"))
    carry = tails.select("__slice", *[F.col(k).alias(f"__{k}") for k in keys], into.alias("__carry")).filter("__carry IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = placed.join(carry.withColumnRenamed("__slice", "__at"), [F.col("__slice") == F.col("__at"), *same], "left")
    return out.withColumn(value, F.coalesce("__in", "__carry")).select(df.columns)


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tie: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` of its key at or before its time, else nulls.

    ``tie`` orders rows of ``right`` at one time; the greatest counts. Both sides are put in one order and cut into
    slices of rows, so a key that owns a third of either side is spread over many tasks, and no
    pairs are formed. A null key or time matches nothing.
    """
    own = F.struct(*left.columns)
    have = F.struct(*values)
    kind, what = left.select(own.alias("r")).schema[0].dataType, right.select(have.alias("v")).schema[0].dataType
    tied = right.schema[tie].dataType
    a = left.select(*keys, t, F.lit(1).alias("__side"), F.lit(None).cast(tied).alias("__tie"), own.alias("__row"), F.lit(None).cast(what).alias("__v"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, t)])
    b = right.filter(known).select(*keys, t, F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(kind).alias("__row"), have.alias("__v"))
    both = cut_lineage(a.filter(known).unionByName(b), "as-of")
    found = carried(both, keys, [t, "__side", "__tie"], "__v", rows).filter("__side = 1").select("__row", "__v")
    alone = a.filter(~known).select("__row", "__v")
    return found.unionByName(alone).select("__row.*", *[F.col("__v")[v].alias(v) for v in values])


def value_chunk(value: Column) -> Column:
    """Order-preserving slices of a number on a log scale: at most some 10^5 of them
    for any range of values, 256 per doubling."""
    steps = F.floor(F.log2(F.abs(value.cast("double")) + 1.0) * 256)
    return (F.signum(value.cast("double")) * steps).cast("long")


def hash_chunk(column: str) -> Column:
    """4096 even slices that keep the order of the md5 text of a column."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 3), 16, 10).cast("long")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    values: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per key; ``values`` maps new column -> summand."""
    totals = df.groupBy(*keys, chunk).agg(
        *[F.sum(v).alias(f"__{name}") for name, v in values.items()]
    )
    w = before(keys, chunk)
    offsets = totals.select(
        *keys,
        chunk,
        *[F.coalesce(F.sum(f"__{n}").over(w), F.lit(0)).alias(f"__{n}") for n in values],
    )
    local = within(keys, chunk, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, chunk])
    out = out.select(
        *df.columns,
        *[(F.sum(v).over(local) + F.col(f"__{n}")).alias(n) for n, v in values.items()],
    )
    return out


def positions(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    name: str = "pos",
) -> DataFrame:
    """0-based position of every row in its key."""
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *keys, chunk, F.coalesce(F.sum("__n").over(before(keys, chunk)), F.lit(0)).alias("__off")
    )
    return df.join(offsets, [*keys, chunk]).select(
        *df.columns,
        (F.row_number().over(within(keys, chunk, order)) - 1 + F.col("__off")).alias(name),
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """lag(1) of ``columns`` per key, carried over chunk borders."""
    row = F.struct(*order, *[c for c in columns if c not in order])
    tails = df.groupBy(*keys, chunk).agg(F.max(row).alias("__tail"))
    carried = tails.select(
        *keys,
        chunk,
        F.lag("__tail").over(Window.partitionBy(*keys).orderBy(chunk)).alias("__tail"),
    )
    w = within(keys, chunk, order)
    first = F.row_number().over(w) == 1
    return df.join(carried, [*keys, chunk]).select(
        *df.columns,
        *[
            F.when(first, F.col(f"__tail.{c}")).otherwise(F.lag(c).over(w)).alias(prefix + c)
            for c in columns
        ],
    )


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    size: int,
    value: Column,
    name: str,
    block: int = 1000,
) -> DataFrame:
    """The last ``size`` values per key up to and including each row.

    Rows are numbered, cut into blocks of ``block`` positions, and the last
    ``size - 1`` rows of a block are repeated in the next one (a halo), so that a
    ROWS frame per (key, block) sees all it needs.
    """
    numbered = positions(df, keys, chunk, order, "__pos")
    home = F.floor(F.col("__pos") / block)
    blocks = F.when(
        F.col("__pos") % block >= block - size + 1, F.array(home, home + 1)
    ).otherwise(F.array(home))
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    w = (
        Window.partitionBy(*keys, "__block")
        .orderBy("__pos")
        .rowsBetween(-(size - 1), 0)
    )
    return (
        spread.withColumn(name, F.collect_list(value).over(w))
        .filter("__block = __home")
        .drop("__block", "__home", "__pos")
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], chunk: Column | None = None
) -> DataFrame:
    """Linear-interpolated percentiles from a histogram of distinct values.

    ``percentile()`` keeps all distinct values of a group in one aggregation
    buffer; here they stay rows, and only the two rows around each rank are read.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    chunk = value_chunk(F.col(value)) if chunk is None else chunk
    hist = running_sum(hist.withColumn("__c", chunk), keys, "__c", [value], {"cum": F.col("n")})
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total")
    )
    ranked = hist.join(totals, list(keys)) if keys else hist.crossJoin(F.broadcast(totals))
    aggs = []
    for p in points:
        rank = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(rank), F.ceil(rank)
        start = F.col("cum") - F.col("n")
        at = lambda r: F.max(F.when((r >= start) & (r < F.col("cum")), F.col(value)))
        frac = F.max(rank - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(f"p{round(p * 100)}"))
    return ranked.groupBy(*keys).agg(*aggs)
