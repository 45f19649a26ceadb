"""Targets by sharing in rounds, thresholds by sorting, against the operator."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op7_mixing as m

WEIGHTS = (5, 2, 1)


def shared_out(sizes, most=3.0):
    """Share by weight, stop whoever is above the limit, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plain(rows):
    sizes, docs = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        docs[source].append((int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16), n))
    target = shared_out(sizes)
    out = []
    for source, own in docs.items():
        size = sizes[source]
        full = int(target[source] // size) if size else 0
        want = target[source] - full * size
        for place, n in own:
            before, peers = sum(x for p, x in own if p < place), sum(x for p, x in own if p == place)
            out.append((source, n, size, n * (full + (before + peers / 2 <= want))))
    return sorted(out, key=repr), target


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.mix(docs, **more).collect()
    return sorted(((r.source, r.size, r.source_size, r.taken) for r in got), key=repr), {r.source: r.target for r in got}


def test_against_plain(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["hot"] * 6 + ["b", "c", "a", None, "tiny"])) for i in range(600)]
    rows = [r if r[2] != "tiny" else (r[0], "x", "tiny") for r in rows] + [(None, None, "b"), (None, "p q", "empty"), (5, "", "zero"), (7, "a b c", "rep"), (7, "a b c", "rep")]
    got, targets = run(spark, rows)
    want, plain_targets = plain(rows)
    assert got == want
    assert targets == pytest.approx(plain_targets)
    assert sum(plain_targets.values()) == pytest.approx(sum(len((t or "").split()) for _, t, _ in rows))
    assert all(taken <= 3 * n for _, n, _, taken in got)
    assert run(spark, rows)[0] == got


def test_nested(spark):
    """A smaller share takes a subset."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 20), f"s{i % 4}") for i in range(300)], "doc_id long, text string, source string")
    small, large = ({r.doc_id: r.taken for r in m.mix(docs, share=s).collect()} for s in (0.3, 0.5))
    assert all(small[i] <= large[i] for i in small) and small != large


def test_clashing_names_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, "k", 3)], "doc_id long, text string, source string, size int, place string, below int")
    r = m.mix(docs).first()
    assert (r.size, r.taken, r.place, r.below) == (2, 2, "k", 3)
    assert m.mix(docs.where(F.lit(False))).collect() == []
    assert [r.taken for r in m.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()] == [0]
