"""Replay of a small state machine over an ordered log, per key.

A step of the machine is a map "state before -> state after" over a handful of
states, and such maps compose. The log of a key is cut into blocks of ``BLOCK``
positions; a block folds to one map, ``BLOCK`` blocks fold to one map again, and the
states entering each block come back down the same ladder. No array is longer than
BLOCK (at the top: rows / BLOCK^2), however long one key's log is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import ordered

BLOCK = 256


def _total(items: Column, states: int) -> Column:
    start = F.array(*[F.lit(i) for i in range(states)])
    return F.aggregate(
        items, start, lambda m, x: F.transform(m, lambda s: F.element_at(x["step"], s + 1))
    )


def _entering(items: Column, state: Column) -> Column:
    """State in front of every item."""
    zero = F.struct(state.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        items,
        zero,
        lambda a, x: F.struct(
            F.element_at(x["step"], a["s"] + 1).alias("s"),
            F.concat(a["out"], F.array(a["s"])).alias("out"),
        ),
        lambda a: a["out"],
    )


def _blocks(df: DataFrame, keys: Sequence[str], unit: str, item: Column, states: int) -> DataFrame:
    out = df.groupBy(*keys, unit).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return out.withColumn("step", _total(F.col("items"), states))


def replay(
    log: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    step: Column,
    states: int,
    start: int = 0,
) -> DataFrame:
    """Add ``state_before`` to every row of the log."""
    rest = [c for c in log.columns if c not in keys and c != chunk]
    placed = ordered.positions(log, keys, chunk, order, "__pos").withColumn("step", step)
    b0 = _blocks(
        placed.withColumn("u0", F.floor(F.col("__pos") / BLOCK)),
        keys, "u0", F.struct("__pos", "step", F.struct(*rest).alias("row")), states,
    )
    b1 = _blocks(
        b0.withColumn("u1", F.floor(F.col("u0") / BLOCK)), keys, "u1", F.struct("u0", "step"), states
    )
    top = b1.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("u1", "step"))).alias("items"))

    def down(df: DataFrame, state: Column, field: str) -> DataFrame:
        pairs = F.arrays_zip(F.transform("items", lambda x: x[field]).alias("v"), _entering(F.col("items"), state).alias("s"))
        return df.select(*keys, F.explode(pairs).alias("p"))

    in1 = down(top, F.lit(start), "u1").select(*keys, F.col("p.v").alias("u1"), F.col("p.s").alias("s"))
    in0 = down(b1.join(in1, [*keys, "u1"]), F.col("s"), "u0").select(
        *keys, F.col("p.v").alias("u0"), F.col("p.s").alias("s")
    )
    rows = down(b0.join(in0, [*keys, "u0"]), F.col("s"), "row")
    return rows.select(*keys, "p.v.*", F.col("p.s").alias("state_before"))
