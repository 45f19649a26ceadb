"""Connected groups and meeting by keys against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import linking


def union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(1000, 1120)]
    star = [(5000, k) for k in range(5001, 5200)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rng.shuffle(edges)
    got = linking.components(spark.createDataFrame(edges + edges[:9] + [(7777, 7777)], "a long, b long"), "t")
    rows = got.collect()
    assert {r.id: r.label for r in rows} == union(edges) and len(rows) == len({r.id for r in rows})
    assert linking.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_shared_members(spark, monkeypatch):
    monkeypatch.setattr(linking, "GROUP_KEYS", 50)
    rng = random.Random(2)
    rows = [(i, [rng.randrange(400) - 200 for _ in range(3)] + ([-(1 << 63)] if i % 3 == 0 else [])) for i in range(300)] + [(1000, [])]
    want = defaultdict(set)
    for i, keys in rows:
        for k in keys:
            want[k].add(i)
    want = {(k, i) for k, ids in want.items() if len(ids) > 1 for i in ids}
    got = linking.shared_members(spark.createDataFrame(rows, "id long, keys array<long>").repartition(5), 4, "t").collect()
    assert {(r.key, r.id) for r in got} >= want and {(r.key, r.id) for r in got} - want <= {(r.key, r.id) for r in got if [k for k in dict(rows)[r.id]].count(r.key) > 1}
    assert len(got) == len(set(got))


def test_near_members(spark, monkeypatch):
    """Every pair within the distance that shares a key stays together under it, whatever is dropped, also with common keys."""
    rng = random.Random(5)
    for small in (3, 64):
        monkeypatch.setattr(linking, "SMALL", small)
        rows = [(i, rng.getrandbits(8) - (1 << 63) * rng.randint(0, 1), [rng.randrange(60) for _ in range(2)] + [-7] * (i % 3 == 0)) for i in range(400)]
        df = spark.createDataFrame(rows, "id long, sketch long, keys array<long>").repartition(4)
        got = {(r.key, r.id) for r in linking.shared_members(df, 3, "t", distance=1).collect()}
        near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 1
        for i, x, keys in rows:
            for j, y, others in rows[:i]:
                for k in set(keys) & set(others) if near(x, y) else ():
                    assert (k, i) in got and (k, j) in got
        if small == 64:
            assert len(got) < sum(len(set(k)) for _, _, k in rows)


def test_linked_is_all_pairs(spark):
    """Near each other means at most 2 apart; leaders alone would miss links between other groups."""
    rng = random.Random(3)
    members = {(rng.randrange(12), rng.randrange(150)) for _ in range(260)}
    df = spark.createDataFrame(sorted(members), "key long, id long")
    verify = lambda pairs: pairs.where(F.abs(F.col("a") - F.col("b")) <= 2)

    def across(open_):
        x, y = open_.alias("x"), open_.alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")))
        return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    got = {r.id: r.label for r in linking.linked(df, verify, across, "t").collect()}
    edges = [(a, b) for k, a in members for k2, b in members if k == k2 and a < b and b - a <= 2]
    assert got == union(edges)


def test_large_groups_of_one_key_meet_before_all_pairs(spark):
    """Two groups, tied within and between, whose keys also hold others: they are one group before pairs are made of all that is left."""
    rng = random.Random(4)
    n = 300
    # The least id of key 1 has no links; those of keys 2 and 3 tie their groups together, so key 1 is left with two large groups.
    members = [(1, 0)] + [(1, i) for i in range(1, 2 * n + 1)] + [(2, i) for i in range(1, n + 1)] + [(3, i) for i in range(n + 1, 2 * n + 1)]
    rng.shuffle(members)
    made = []

    def verify(pairs):
        return pairs.where("a > 0 AND b > 0")

    def across(open_):
        x, y = open_.alias("x"), open_.alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")))
        pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        made.append(pairs.count())
        return pairs

    df = spark.createDataFrame(members, "key long, id long")
    got = {r.id: r.label for r in linking.linked(df, verify, across, "t").collect()}
    assert {got[i] for i in range(1, 2 * n + 1)} == {1} and got.get(0, 0) == 0
    assert made[0] <= 4 * n  # all pairs of the two groups are n * n
