"""Lloyd rounds with bounds against plain integers in Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op12_centroids as m


def plain(rows, dims, scale, k, rounds, seed=m.SEED):
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= m.LARGEST]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found) if f == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), centroids


def vectors(rng, n, dims, groups):
    middles = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(groups)]
    return [(i, [rng.gauss(x, 0.3) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("dims,k,rounds,groups", [(3, 5, 4, 6), (8, 4, 3, 4), (2, 7, 6, 1), (4, 1, 2, 2)])
def test_against_plain(spark, dims, k, rounds, groups):
    rows = vectors(random.Random(dims), 400, dims, groups)
    rows += [(900, None), (901, [1.0] * (dims + 1)), (902, [None] * dims), (903, [math.nan] * dims), (904, [math.inf] * dims), (905, []), (None, [0.5] * dims), (7, rows[7][1]), (906, [300.0] * dims), (907, [-9000.25] * dims)]
    rows += [(908, [1e30] * dims)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("cluster", F.lit(1)).repartition(5)
    got, centroids = m.clustered(table, dims=dims, scale=16, k=k, rounds=rounds)
    want, middles = plain(rows, dims, 16, k, rounds)
    assert got.columns == ["vec_id", "cluster", "distance"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert centroids.tolist() == middles


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 1, 3, -1])]
    got, _ = m.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=2, scale=1, k=3, rounds=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 2, 1, 3, 2)[0]


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, centroids = m.clustered(table, dims=2, k=16)
    out = m.with_inertia(got, centroids).collect()
    assert sorted(r["vec_id"] for r in out) == [1, 2] and {r["inertia"] for r in out} == {0} and len(centroids) == 2
    got, centroids = m.clustered(table.where("vec_id > 5"), dims=2, k=16)
    assert m.with_inertia(got, centroids).collect() == []


def test_sphere_drift_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(300):
        dims = int(rng.integers(2, 6))
        centre, a = rng.normal(size=(2, dims)) * 3
        b = a + rng.normal(size=dims) * rng.uniform(0.01, 2)
        radius = rng.uniform(0, 3)
        x = rng.normal(size=(4000, dims))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, size=(4000, 1)) ** (1 / dims)
        gap = np.linalg.norm(x - a, axis=1) - np.linalg.norm(x - b, axis=1)
        bound, full = m.sphere_drift(centre, radius, a, b), np.linalg.norm(b - a)
        assert gap.max() <= bound + 1e-9 and bound <= full + 1e-12
        shares.append(bound / full)
    assert np.mean(shares) < 0.6  # the full drift would be 1


def test_bounds_spare_scans():
    """Once centroids move little, few vectors are looked at, fewer than with the full drift."""
    rng = random.Random(1)
    rows = np.floor(np.array([v for _, v in vectors(rng, 3000, 6, 8)]) * 64).astype(np.int64)
    old, spared, by_drift = rows[:8].copy(), [], []
    for _ in range(8):
        cluster, upper, lower = m.scanned(rows, old)
        new = np.array([rows[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) for c in range(8)])
        radius = np.array([upper[cluster == c].max() for c in range(8)])
        drift, shrink = m.loosening(old.astype(float), new.astype(float), radius)
        exact, _, _ = m.scanned(rows, new)
        sure = upper + drift[cluster] < lower - shrink[cluster]
        assert (exact[sure] == cluster[sure]).all() and (shrink <= drift.max() + 1e-9).all()
        spared.append(sure.mean())
        by_drift.append((upper + drift[cluster] < lower - drift.max()).mean())
        old = new
    assert max(spared) > 0.5 and all(a >= b for a, b in zip(spared, by_drift)) and sum(spared) > sum(by_drift)


def test_packed_numbers():
    rows = np.array([[1, -128], [127, -127], [32767, 5], [-32768, 0], [1 << 27, -(1 << 27)]])
    column = m.packed(rows)
    assert (m.unpacked(column, 2) == rows).all() and [len(x) for x in column.to_pylist()] == [4, 2, 4, 8, 8]
    big = np.array([[1 << 27, -(1 << 27)]])
    assert m.squared(big, -big).tolist() == [[2 * (1 << 28) ** 2]]
