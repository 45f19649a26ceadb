"""Connected groups of rows that share buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage, discard

U64 = np.uint64
#: Keys that are compared at once; rows of a batch, or of a key, that count as few.
GROUP_KEYS, SMALL = 500_000, 64
#: Links, keys and labels are a few numbers a row; so many of them are written by one task.
TASK_ROWS, LEAST_TASKS = 200_000, 8

#: Ids that lead a large key in a turn; share of the open rows that must change their group for another turn.
LEADS, LEAST_MOVED = 4, 0.05

Pairs = Callable[[DataFrame], DataFrame]


def written(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Write a table of short rows, of which there are about `rows`, by as many tasks as that takes."""
    return cut_lineage(df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS)), name)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, label) of every id in `edges` (a, b): label is the least id it is connected with.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm
    of the largest group. The minima are written before they are joined, so that Spark can split
    the rows of an id with many links.
    """
    rows = edges.count()
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, rows, f"{name}-edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, rows, f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, rows, f"{name}-large")
        below = written(large.groupBy("u").agg(F.min("v").alias("m")), rows, f"{name}-below")
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(small.union(below.select("u", F.col("m").alias("v"))).distinct(), rows, f"{name}-edges")
        discard(before, least, large, below)
    # Now every id points at the least one of its group.
    out = written(e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select("v", "v")).distinct(), rows, f"{name}-labels")
    discard(e)
    return out


def shared_members(rows: DataFrame, keys_per_row: int, name: str, distance: int | None = None) -> DataFrame:
    """(key, id) of the keys that two ids or more hold; `rows` has id (distinct) and keys (array of 64-bit numbers).

    Keys travel packed, by hash range, and meet in groups of bounded size: a key that more than
    SMALL rows of a batch hold is sent once, for the least of them, and its other holders are
    settled in their own task, so a key that a third of all rows hold meets in small numbers.
    With `distance`, `rows` has a 64-bit sketch too, and of the up to SMALL ids that meet under a
    key those stay that differ in at most so many bits from another; larger groups stay whole.
    """
    sketch = "id" if distance is None else "sketch"
    groups = U64(max(16, 1 << (rows.count() * keys_per_row // GROUP_KEYS).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(key)
            key, row = key[order], row[order]
            id_, near = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", sketch))
            first, size = runs_of(key)
            common = np.repeat(size > SMALL, size)
            # These need no comparison; each task has a bucket of its own for them, so that no reducer gets them all.
            yield packed(np.array([-1 - TaskContext.get().partitionId()]), [(key[common], id_[common], near[common], common[common])])
            lead = np.zeros(len(key), dtype=bool)
            lead[first] = True
            sent = lead | ~common
            key, id_, near, common = key[sent], id_[sent], near[sent], common[sent]
            group = (key % groups).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cut, _ = runs_of(group[order])
            if len(cut):
                yield packed(group[order][cut], [(key[g], id_[g], near[g], common[g]) for g in np.split(order, cut[1:])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def out(key: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(id_)], ["key", "id"])

        def settled() -> pa.RecordBatch:
            key, id_, near, common = map(np.concatenate, zip(*held))
            order = np.argsort(key)
            key, id_, near, common = key[order], id_[order], near.view(U64)[order], common[order]
            first, size = runs_of(key)
            if distance is None:
                stay = np.repeat(size > 1, size)
            else:
                stay = np.repeat((size > SMALL) | (len(key) > 0 and np.logical_or.reduceat(common, first)), size)
                left = np.repeat(first + size, size) - np.arange(len(key))
                for step in range(1, SMALL):
                    at = np.flatnonzero(left > step)
                    if not len(at):
                        break
                    alike = at[np.bitwise_count(near[at] ^ near[at + step]) <= distance]
                    stay[alike] = stay[alike + step] = True
            return out(key[stay], id_[stay])

        for batch in batches:
            for row in batch.to_pylist():
                part = tuple(np.frombuffer(row[c], dtype=t) for c, t in PACKED)
                if row["bucket"] < 0:
                    yield out(*part[:2])
                    continue
                if row["bucket"] != current and held:
                    yield settled()
                    held = []
                current = row["bucket"]
                held.append(part)
        if held:
            yield settled()

    sent = rows.mapInArrow(send, "bucket long, " + ", ".join(f"{c} binary" for c, _ in PACKED))
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, id long")
    return cut_lineage(met.distinct(), f"{name}-members")


PACKED = (("keys", U64), ("ids", np.int64), ("sketches", np.int64), ("common", np.bool_))


def packed(bucket: np.ndarray, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    parts = [pa.array([x.astype(t).tobytes() for x in column], pa.binary()) for column, (_, t) in zip(zip(*rows), PACKED)]
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), *parts], ["bucket", *(c for c, _ in PACKED)])


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(x)))


def linked(members: DataFrame, verify: Pairs, across: Pairs, name: str) -> DataFrame:
    """(id, label) of all ids that are linked; `members` has key and id, keys
    of one id left out or not.

    Two ids are linked if they share a key and `verify` keeps their pair (a, b); connected ids get
    one label, the least of them. In each bucket the least id is compared with the others, and what
    then hangs together needs no more comparisons: copies and near copies fall into one group,
    whatever their number. Large buckets of more than one group are led anew, by ids drawn by their
    hash, as long as that joins groups of many ids. What buckets of more than one group still hold goes on: `across` turns (key,
    id, label) into pairs of different labels and must give all that `verify` would keep.
    """
    shared = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    rows = members.count()
    shared = written(shared.select("key", "leader"), rows, f"{name}-shared")
    inside = written(members.join(shared, "key").distinct(), rows, f"{name}-inside")

    def links(pairs: DataFrame, step: str) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut_lineage(pairs, f"{name}-pairs-{step}")
        out = cut_lineage(verify(pairs).select("a", "b"), f"{name}-links-{step}")
        discard(pairs)
        return out

    found = links(inside.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")), "led")
    labels = components(found, f"{name}-led")
    now = inside.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    now = written(now, rows, f"{name}-labelled")
    discard(shared, inside, found)
    open_ = still_open(now, rows, name)
    discard(now)
    more = []
    for turn in count():
        sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        held, alike = sizes.agg(F.sum("n"), F.sum(F.when(F.col("n") > SMALL, F.col("n") * F.col("n")))).first()
        if (alike or 0) < SMALL * (held or 0) or not held:
            break
        drawn = [F.max_by(F.struct("id", "label"), F.xxhash64("id", F.lit(turn * LEADS + k))) for k in range(LEADS)]
        leads = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*drawn)).alias("leads")).where(F.col("n") > SMALL)
        leads = written(leads.select("key", F.explode("leads").alias("lead")), held, f"{name}-leads")
        pairs = open_.join(leads, "key").where("label != lead.label").select(F.col("id").alias("a"), F.col("lead.id").alias("b"))
        found = links(pairs, f"led-{turn}")
        more.append(found)
        own = open_.select("id", "label").distinct()
        a, b = (own.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
        # Groups are joined as groups; their ids follow at the end.
        joined = components(found.join(a, "a").join(b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), f"{name}-led-{turn}")
        joined = joined.where("id != label").select(F.col("id").alias("label"), F.col("label").alias("first"))
        now = open_.join(joined, "label", "left").select("key", "id", F.coalesce("first", "label").alias("label"), F.col("first").isNotNull().alias("moved"))
        now = written(now, held, f"{name}-labelled")
        moved = now.where("moved").count()
        discard(open_, leads)
        open_ = still_open(now.drop("moved"), held, name)
        discard(now)
        if moved < LEAST_MOVED * held:
            break
    found = links(across(open_), "across")
    discard(open_)
    for part in more:
        found = found.union(part)
    if found.isEmpty():
        return labels
    return components(found.union(labels.select("id", "label")), f"{name}-across")


def still_open(members: DataFrame, rows: int, name: str) -> DataFrame:
    """(key, id, label) of the keys that more than one label holds."""
    mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    mixed = written(mixed, rows, f"{name}-mixed")
    out = written(members.join(mixed, "key"), rows, f"{name}-open")
    discard(mixed)
    return out
