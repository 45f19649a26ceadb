"""Signatures follow weighted Jaccard similarity; classes equal brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_linking import union
from tidewatch.llm import op6_minhash as m


@pytest.mark.parametrize("kind", ["unit", "counts", "reals", "small"])
def test_agreement_is_similarity(kind):
    rng = np.random.default_rng(0)
    agree, exact = [], []
    for _ in range(30):
        n = 3 if kind == "small" else 60
        element = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        draw = {"unit": lambda: np.ones(n), "small": lambda: np.ones(n), "counts": lambda: rng.integers(1, 40, n).astype(float), "reals": lambda: rng.random(n) * 7 + 0.01}[kind]
        a, b = np.zeros(2 * n), np.zeros(2 * n)
        a[:n] = draw()
        b[n // 3 : n // 3 + n] = draw()
        ia, ib = np.flatnonzero(a), np.flatnonzero(b)
        doc = np.concatenate([np.zeros(len(ia), int), np.ones(len(ib), int)])
        s = m.signatures(doc, np.concatenate([element[ia], element[ib]]), np.concatenate([a[ia], b[ib]]), 3, 256)
        assert (s[2] == 0).all() and (s[:2] != 0).all()
        agree.append((s[0] == s[1]).mean())
        exact.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert np.mean(agree) == pytest.approx(np.mean(exact), abs=0.03)


def shingles(text, counted=False):
    w = (text or "").split()
    runs = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    times = Counter(runs)
    return {(r, k) for r, n in times.items() for k in range(n if counted else 1)}


def corpus(rng):
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows, key = [], 0
    for text in base:
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((key, rng.choice([" ", "\n"]).join(words)))
            key += 1
    passage = " ".join(f"s{k}" for k in range(60))
    rows += [(1000 + k, passage + " " + " ".join(f"t{k}_{j}" for j in range(rng.randint(1, 60)))) for k in range(60)]  # a shared passage
    rows += [(2000 + k, "hot copy of a text with words") for k in range(100)]
    rows += [(3000 + k, " ".join(["again"] * (5 + 3 * k))) for k in range(6)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (4003, "one two"), (4004, "one  two"), (4005, "one three"), (None, "hot copy of a text with words"), (2000, "hot copy of a text with words")]
    return rows


@pytest.mark.parametrize("counted", [False, True])
def test_classes(spark, counted):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).repartition(6)
    got = m.near_duplicates(docs, counted=counted).collect()
    assert len(got) == len(rows) and [r.class_id for r in got if r.doc_id is None] == [None]
    known = [(i, shingles(t, counted)) for i, t in rows if i is not None]
    edges = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if len(x & y) >= 0.8 * len(x | y)]
    want = {i: i for i, _ in known} | union((min(e), max(e)) for e in edges)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want


def test_all_pairs_across_groups(spark):
    """The prefixes of any two sets that are near enough meet."""
    rng = random.Random(11)
    sets = []
    for k in range(80):
        s = set(sets[rng.randrange(k)]) if k and rng.random() < 0.7 else set(rng.sample(range(400), rng.randint(1, 30)))
        sets.append(s ^ set(rng.sample(range(400), rng.randint(0, 3))) or {k})
    lists = spark.createDataFrame([(k, list(s)) for k, s in enumerate(sets)], "id long, elements array<long>")
    labels = spark.createDataFrame([(k, k % 50) for k in range(80)], "id long, label long")
    got = {(min(r), max(r)) for r in m.prefix_pairs(lists, labels, 0.8).collect()}
    want = {(a, b) for b in range(80) for a in range(b) if a % 50 != b % 50 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 5


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
