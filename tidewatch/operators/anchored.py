"""Anchored greedy windows.

The first row of a key opens a window of width W; rows up to and including
``anchor + W`` belong to it; the next later row is the next anchor. Neither
``window`` nor ``session_window`` expresses this, and a plain fold per key would pull
a hot key into one task.

The distinct times are put in order by (key, time) and cut into slices of about ``slice_rows``
rows, wherever keys begin or end. No step sees more than a slice at once:

1. per slice: how far a chain of anchors that begins at a row reaches within the slice;
2. for keys that cross a slice's border: the row at which such a chain enters a later slice,
   found by an as-of join, so that each row points to its entry;
3. pointer jumping: pointers over 1, 2, 4, ... entries are joined row by row; from the key's
   first row they give all entries of its chain, in as many rounds as the chain has binary digits;
4. per slice: replay from the entry now known.

All joins are on rows of distinct times, so a flooding key is spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.session import cut_lineage

SLICE_ROWS = 20_000
NEVER = -(2**62)


def _segments(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the key of each row; rows come by key."""
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    last = np.r_[first[1:], len(k)]
    return np.repeat(first, last - first), np.repeat(last, last - first)


def _next(t: np.ndarray, w: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row the first one of its key beyond its window, or the key's end: a binary search of all rows at once."""
    low, high = np.arange(len(t)) + 1, end.copy()
    while (low < high).any():
        middle = (low + high) // 2
        beyond = t[np.minimum(middle, len(t) - 1)] > t + w
        open_ = low < high
        high = np.where(open_ & beyond, middle, high)
        low = np.where(open_ & ~beyond, middle + 1, low)
    return low


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One slice: the place of each row and the time up to which a chain from it covers."""
    held = [pdf for pdf in batches if len(pdf)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    t, w = pdf["t"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
    _, end = _segments(pdf["k"].to_numpy())
    step = _next(t, w, end)
    hop = np.where(step < end, step, np.arange(len(t)))
    while not np.array_equal(hop[hop], hop):
        hop = hop[hop]
    part = TaskContext.get().partitionId()
    yield pdf.assign(part=part, place=(part << 32) + np.arange(len(t)), reach=t[hop] + w[hop])


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """The anchors of one slice; ``covered`` and ``entry`` tell what comes from the slices before."""
    pdf = pdf.sort_values("place", ignore_index=True)
    t, w = pdf["t"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
    covered, entry = pdf["covered"].to_numpy(np.int64), pdf["entry"].to_numpy(np.int64)
    begin, end = _segments(pdf["k"].to_numpy())
    step = _next(t, w, end)
    starts = np.unique(begin)
    cur = np.where(covered[starts] == NEVER, starts, np.where(entry[starts] < 0, -1, entry[starts] - pdf["place"].iloc[0]))
    cur = cur[cur >= 0]
    mark = np.zeros(len(t), bool)
    while len(cur):
        mark[cur] = True
        cur = step[cur][step[cur] < end[cur]]
    seen = np.maximum.accumulate(np.where(mark, np.arange(len(t)), -1))
    anchor = np.where(seen >= begin, t[np.maximum(seen, 0)], covered - w)
    return pdf[["k", "t", "first_id"]].assign(anchor=anchor)


def times_of(df: DataFrame, t: str, row_id: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Distinct (k, t, w) in slices: part, place (part and number in it), first_id and reach."""
    times = cut_lineage(df.groupBy("k", F.col(t).alias("t"), "w").agg(F.min(row_id).alias("first_id")), "anchored-times")
    parts = max(1, -(-times.count() // slice_rows))
    kind = times.schema["first_id"].dataType.simpleString()
    schema = f"k string, t long, w long, first_id {kind}, part int, place long, reach long"
    placed = times.repartitionByRange(parts, "k", "t").sortWithinPartitions("k", "t").mapInPandas(_place, schema)
    return cut_lineage(placed, "anchored-placed")


def _entries(placed: DataFrame, slice_rows: int) -> DataFrame:
    """k, part, entry (place of the first anchor in the slice, or null) and covered, for keys in more than one slice."""
    # one row for each slice's border at most
    spans = cut_lineage(placed.groupBy("k").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b"), "anchored-spans")
    if spans.isEmpty():
        return spans.selectExpr("k", "a AS part", "CAST(NULL AS BIGINT) AS entry", "CAST(NULL AS BIGINT) AS covered")
    rows = placed.join(spans, "k")
    leaving = rows.filter("part < b")
    asked = leaving.select("k", "reach").distinct().withColumn("at", -F.col("reach") - 1)
    ahead = rows.select("k", (-F.col("t")).alias("at"), F.col("place").alias("to"))
    found = ordered.as_of(asked, ahead, ["k"], "at", ["to"], "to", slice_rows).filter("to IS NOT NULL").select("k", "reach", "to")
    jumps = [cut_lineage(leaving.join(found, ["k", "reach"]).select("place", "to"), "anchored-jumps")]
    while not jumps[-1].isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        twice = a.join(b, F.col("a.to") == F.col("b.place")).select("a.place", "b.to")
        jumps.append(cut_lineage(twice, "anchored-jumps"))
    chain = rows.filter("part = a").groupBy("k").agg(F.min("place").alias("place")).select("place")
    for jump in reversed(jumps[:-1]):
        chain = cut_lineage(chain.union(chain.join(jump, "place").select(F.col("to").alias("place"))), "anchored-chain")
    entered = rows.join(chain, "place").select("k", "part", F.col("place").alias("entry"), "reach")
    upto = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    slices = rows.select("k", "part").distinct().join(entered, ["k", "part"], "left")
    return slices.select("k", "part", "entry", F.last("reach", ignorenulls=True).over(upto).alias("covered"))


def anchored_windows(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    width_us: int | Column,
    row_id: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every input row with ``anchor`` (window start time) and ``opens`` (it is the
    row that opened the window; ties at one time go to the smallest row id).

    A width that is a column must be the same for all rows of a key.
    """
    w = F.lit(width_us) if isinstance(width_us, int) else width_us
    k = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in keys])
    keyed = df.withColumn("k", k).withColumn("w", w.cast("long"))
    placed = times_of(keyed, t, row_id, slice_rows)
    known = cut_lineage(_entries(placed, slice_rows), "anchored-entries")
    given = placed.join(known, ["k", "part"], "left").select(
        "k", "t", "w", "first_id", "part", "place", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("covered", F.lit(NEVER)).alias("covered")
    )
    schema = f"k string, t long, first_id {placed.schema['first_id'].dataType.simpleString()}, anchor long"
    times = given.groupBy("part").applyInPandas(_replay, schema).select("k", F.col("t").alias(t), "first_id", "anchor")
    return (
        keyed.join(times, ["k", t])
        .withColumn("opens", (F.col(t) == F.col("anchor")) & (F.col(row_id) == F.col("first_id")))
        .select(*df.columns, "anchor", "opens")
    )
