"""Joins whose hot keys are salted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: Rows of one key that one task may join.
HOT_ROWS = 100_000


def salted_join(
    big: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join a table with hot keys to a table of one row per key.

    The keys of ``big`` are counted first (map-side combined); there are at most rows / hot_rows hot ones, which
    are stored. Only their rows on the small side are repeated once per salt, so a hot key spreads over ``salts``
    tasks and the small side keeps about its size, by which Spark decides whether to broadcast it. Rows without a
    key match nothing and are spread too.
    """
    n = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = cut_lineage(n.select(*keys, F.lit(True).alias("__hot")), "hot")
    plain = [c for c, t in big.dtypes if "<" not in t and t != "binary"]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(salts)).cast("int")
    none = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = big.join(hot, list(keys), "left").withColumn("__salt", F.when(F.col("__hot") | none, salt).otherwise(0)).drop("__hot")
    return left.join(repeated(per_key, hot, keys, salts), [*keys, "__salt"], how).drop("__salt")


def repeated(per_key: DataFrame, hot: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """The small side with its salt: hot keys once per salt, all others once."""
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return per_key.join(hot, list(keys), "left").withColumn("__salt", F.explode(copies)).drop("__hot")
