"""Removal of repeated byte strings against plain Python, and the suffix ranks against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op13_suffixes as m


def plain(rows, width):
    data = [(text or "").encode() for _, text in rows]
    seen = Counter(t[p : p + width] for t in data for p in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, data):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def pieces(rng, width):
    """Texts of shared passages, cut anywhere, with words changed, letters that recur and runs of one letter."""
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 3 * width // 4))) for _ in range(6)]
    rows = []
    for i in range(80):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            part = p[a : a + rng.randint(width // 2, 4 * width)]
            if rng.random() < 0.5:
                k = rng.randrange(len(part) + 1)
                part = part[:k] + rng.choice("XYZ") + part[k:]
            text += part + " ".join(rng.choices(words, k=rng.randint(0, 10)))
        rows.append((i, text))
    rows += [(100 + i, x) for i, x in enumerate(["a" * (width - 1), "a" * width, "b" * (width + 3), "ab" * width, "abc" * width + "d" * 3 * width, "cab" * width])]
    return rows + [(200, None), (201, ""), (202, rows[5][1]), (202, rows[5][1]), (None, rows[7][1]), (203, "é" * width)]


@pytest.mark.parametrize("width,seed", [(400, 1), (60, 2), (12, 3)])
def test_against_plain(spark, width, seed):
    rows = pieces(random.Random(seed), width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("row", F.lit(1)).repartition(6)
    got = m.without_repeats(docs, width=width)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = sorted(((*r[:5], bytes(r["kept"])) for r in got.collect()), key=repr)
    want = plain(rows, width)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 20 and sum(0 < r[2] < r[1] for r in want) > 5


def test_nothing_repeated_and_empty(spark):
    docs = spark.createDataFrame([("x", "abc " * 10), ("y", None)], "doc_id string, text string")
    assert sorted(tuple(r)[:4] for r in m.without_repeats(docs).collect()) == [("x", 40, 0, 0), ("y", 0, 0, 0)]
    assert m.without_repeats(docs.where(F.lit(False))).collect() == []


def test_very_long_text(spark):
    """More than a block of text, with a passage at both ends that another document holds."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = noise(1000)
    rows = [(1, passage + noise(600_000) + passage[100:]), (2, noise(50) + passage[:500]), (3, noise(2000))]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in m.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect()}
    assert got == {1: (1900, 2), 2: (500, 1), 3: (0, 0)}


def test_ranks_are_the_order_of_suffixes(spark):
    """Chains over a tiny alphabet, so that many levels of names are needed."""
    rng = random.Random(5)
    shape = m.Shape(400)
    rows, base = [], 0
    for _ in range(12):
        n = rng.randint(1, 120)
        rows.append((base, [rng.randint(1, 2) for _ in range(n)]))
        base += n
    rows.append((base, [1] * 90))
    syms, suffixes = [], {}
    for base, word in rows:
        for k, x in enumerate(word):
            syms.append((base + k, x))
            suffixes[base + k] = tuple(word[k:])
    letters = sorted(x for _, x in syms)
    syms = [(i, 1 + letters.index(x)) for i, x in syms]
    marked = [(b, [*range(len(w))], [*range(1, len(w)), -1]) for b, w in rows]
    chains = m.chains_of(spark.createDataFrame(marked, "base long, at array<int>, follow array<int>"))
    got = {r["id"]: r["rank"] for r in m.suffix_ranks(chains, spark.createDataFrame(syms, "id long, sym long"), 0, shape).collect()}
    order = sorted(suffixes.values())
    assert got == {i: 1 + order.index(s) for i, s in suffixes.items()}


def test_jumps():
    follow = np.array([1, 3, 3, 4, -1])
    assert [x.tolist() for x in m.jumps(follow, 0)] == [[3, 2, 2, 1, 0], [1, 3, 3, 4, -1], [3, 4, 4, -1, -1], [4, -1, -1, -1, -1]]
    assert [x.tolist() for x in m.jumps(follow, 1)] == [[3, 2, 2, 1, 0], [4, -1, -1, -1, -1], [-1] * 5, [-1] * 5]


def test_offsets_of_one_class():
    """Windows of four bytes over a core of two: what lies left and behind decides at each distance."""
    left = np.frombuffer(b"xa" b"ya" b"xb", dtype=np.uint8).reshape(3, 2)
    rest = np.frombuffer(b"pq" b"pr" b"pq", dtype=np.uint8).reshape(3, 2)
    low, high, n = np.zeros(3, dtype=int), np.full(3, 2), np.array([1, 1, 1])
    got = m.repeated_offsets(np.zeros(3, dtype=int), n, low, high, left, rest, 3)
    assert got.tolist() == [[True, True, False], [False, True, False], [True, False, False]]
    assert m.repeated_offsets(np.arange(3), n, low, high, left, rest, 3).sum() == 0
    assert m.repeated_offsets(np.arange(3), n + 1, low, high, left, rest, 3).all()
