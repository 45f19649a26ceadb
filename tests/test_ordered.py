"""Chunked per-key operators against plain Python, with one key holding half the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anchored, fold, ordered


def skewed(n=4000, span=200_000, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.5, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    t = rng.integers(0, span, n)
    if ties:
        t[: n // 4] = t[n // 4 : 2 * (n // 4)]
    return [(str(k), int(x), i) for i, (k, x) in enumerate(zip(keys, t))]


def by_key(data):
    out = {}
    for k, t, i in data:
        out.setdefault(k, []).append((t, i))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def data():
    return skewed()


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k string, t long, id long").withColumn("chunk", ordered.time_chunk("t", 700))


def test_positions(table, data):
    got = {r["id"]: r["pos"] for r in ordered.positions(table, ["k"], "chunk", ["t", "id"]).collect()}
    assert got == {i: p for v in by_key(data).values() for p, (_, i) in enumerate(v)}


def test_running_sum(table, data):
    out = ordered.running_sum(table, ["k"], "chunk", ["t", "id"], {"s": F.col("id")})
    want = {}
    for v in by_key(data).values():
        s = 0
        for _, i in v:
            s += i
            want[i] = s
    assert {r["id"]: r["s"] for r in out.collect()} == want


def test_previous(table, data):
    out = ordered.previous(table, ["k"], "chunk", ["t", "id"], ["t", "id"])
    want = {}
    for v in by_key(data).values():
        for a, b in zip([(None, None), *v], v):
            want[b[1]] = a
    assert {r["id"]: (r["prev_t"], r["prev_id"]) for r in out.collect()} == want


@pytest.mark.parametrize("block", [7, 1000])
def test_trailing_rows(table, data, block):
    out = ordered.trailing_rows(table, ["k"], "chunk", ["t", "id"], 5, F.col("id"), "last", block)
    want = {}
    for v in by_key(data).values():
        for p, (_, i) in enumerate(v):
            want[i] = [x for _, x in v[max(0, p - 4) : p + 1]]
    assert {r["id"]: r["last"] for r in out.collect()} == want


def test_exact_percentiles(spark):
    x = np.random.default_rng(3).normal(size=1001).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = ordered.exact_percentiles(df, [], "v", [0.0, 0.5, 0.95, 0.991, 1.0]).first()
    assert np.allclose(list(got), np.percentile(x, [0, 50, 95, 99.1, 100]))


def greedy(times, width):
    out, anchor = {}, None
    for t, i in times:
        opens = anchor is None or t > anchor + width
        anchor = t if opens else anchor
        out[i] = (anchor, opens)
    return out


@pytest.mark.parametrize(("width", "slice_rows"), [(60, 300), (500, 700), (3, 5000), (10**7, 400), (0, 900), (5000, 250)])
def test_anchored_windows(table, data, width, slice_rows):
    out = anchored.anchored_windows(table, ["k"], "t", width, "id", slice_rows)
    want = {}
    for v in by_key(data).values():
        want |= greedy(v, width)
    assert {r["id"]: (r["anchor"], r["opens"]) for r in out.collect()} == want


def test_anchored_periodic(spark):
    """Even spacing: chains from different starts never meet."""
    data = [("a", 7 * i, i) for i in range(3000)] + [("b", 10 * i + i % 3, 3000 + i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, t long, id long")
    out = anchored.anchored_windows(df, ["k"], "t", 100, "id", 500)
    want = {}
    for v in by_key(data).values():
        want |= greedy(v, 100)
    assert {r["id"]: (r["anchor"], r["opens"]) for r in out.collect()} == want


def test_anchored_width_per_key(spark):
    data = [(f"k{i % 3}", i * 5, i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t long, id long")
    w = F.when(F.col("k") == "k0", 10).when(F.col("k") == "k1", 100).otherwise(1000)
    out = anchored.anchored_windows(df, ["k"], "t", w, "id", 200)
    want = {}
    for k, v in by_key(data).items():
        want |= greedy(v, {"k0": 10, "k1": 100, "k2": 1000}[k])
    assert {r["id"]: (r["anchor"], r["opens"]) for r in out.collect()} == want


def test_anchored_small_batches(spark, table, data):
    """Groups cut by Arrow batch borders are put together again."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = anchored.anchored_windows(table, ["k"], "t", 400, "id", 1000)
        want = {}
        for v in by_key(data).values():
            want |= greedy(v, 400)
        assert {r["id"]: (r["anchor"], r["opens"]) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_key_is_cut_by_rows(spark):
    """A flooding key: its windows are far longer than a slice, and no slice holds more than a set number of rows."""
    df = spark.range(6000).selectExpr("'hot' AS k", "id * 3 + id % 2 AS t", "id")
    placed = anchored.times_of(df.withColumn("w", F.lit(4000).cast("long")), "t", "id", 300)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 900 and sum(sizes) == 6000
    for width in (4000, 5):
        out = anchored.anchored_windows(df, ["k"], "t", width, "id", 300)
        want = greedy([(i * 3 + i % 2, i) for i in range(6000)], width)
        assert {r["id"]: (r["anchor"], r["opens"]) for r in out.collect()} == want


@pytest.mark.parametrize("rows", [400, 10_000])
def test_as_of(spark, data, rows):
    """Against a walk; one key holds half of both sides, some keys and times are null."""
    right = [(k, t, 10_000 + i) for k, t, i in skewed(1500, seed=4)] + [("hot", None, 1), (None, 5, 2)]
    left = [*data, ("nowhere", 5, -1), (None, 5, -2), ("hot", None, -3), ("hot", -1, -4)]
    schema = "k string, t long, id long"
    r = spark.createDataFrame(right, schema).withColumnRenamed("id", "version")
    got = ordered.as_of(spark.createDataFrame(left, schema), r, ["k"], "t", ["version"], "version", rows)
    known = by_key([x for x in right if None not in x])
    want = {}
    for k, t, i in left:
        past = [v for s, v in known.get(k, []) if t is not None and s <= t]
        want[i] = past[-1] if past else None
    assert got.columns == ["k", "t", "id", "version"] and {x["id"]: x["version"] for x in got.collect()} == want
    assert sum(v is not None for v in want.values()) > 1000


def test_slices_and_carried(spark, data):
    df = spark.createDataFrame(data, "k string, t long, id long").withColumn("v", F.when(F.col("id") % 50 == 0, F.col("id")))
    placed = ordered.sliced(df, ["k", "t", "id"], rows=500)
    assert max(r["count"] for r in placed.groupBy("slice").count().collect()) <= 1500
    pos = {r["id"]: r["pos"] for r in ordered.positions(placed, ["k"], "slice", ["t", "id"]).collect()}
    assert pos == {i: p for v in by_key(data).values() for p, (_, i) in enumerate(v)}
    got = {r["id"]: r["v"] for r in ordered.carried(df, ["k"], ["t", "id"], "v", 500).collect()}
    want = {}
    for v in by_key(data).values():
        now = None
        for _, i in v:
            now = i if i % 50 == 0 else now
            want[i] = now
    assert got == want


def test_fold_over_many_blocks(spark, table, data, monkeypatch):
    monkeypatch.setattr(fold, "BLOCK", 5)
    step = F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(0), F.lit(2))
    )
    out = fold.replay(table, ["k"], "chunk", ["t", "id"], step, 3)
    want = {}
    for v in by_key(data).values():
        s = 0
        for _, i in v:
            want[i] = s
            s = [1, 2, 0][s] if i % 3 == 0 else [0, 0, 2][s]
    assert {r["id"]: r["state_before"] for r in out.collect()} == want
