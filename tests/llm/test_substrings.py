"""Removed windows against plain Python, whatever the sketch lets through."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op3_substrings as m
from tidewatch.llm.textblocks import U64


def plain(rows, width):
    first = {}
    words = [(i if i is not None else 1 << 63, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            run = tuple(w[k : k + width])
            first[run] = min(first.get(run, i), i)
    out = []
    for (i, w), row in zip(words, rows):
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((row[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def rows_with_passages(rng, n, width):
    passages = [[f"p{k}w{j}" for j in range(width + rng.randint(0, 30))] for k in range(5)]
    out = []
    for i in range(n):
        words = [f"u{i}x{j}" for j in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            cut = rng.randint(0, 5)
            words[at:at] = p[cut:]
        out.append((rng.randint(0, 10**6), (" " if i % 2 else "\n\t").join(words)))
    hot = " ".join(f"h{j}" for j in range(width + 7))
    out += [(2_000_000 + k, hot) for k in range(n // 2)]  # a third of all rows
    return out + [(None, hot), (None, None), (-5, ""), (9, "a " * (3 * width)), (8, "a " * (2 * width)), (2_000_000, hot)]


@pytest.mark.parametrize("width", [3, 10, 50])
def test_against_plain(spark, width):
    rows = rows_with_passages(random.Random(width), 120, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("x")).repartition(5)
    got = m.without_repeats(docs, width=width)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, width)


def test_saturated_sketch_loses_nothing(spark, monkeypatch):
    """With every cell full, all windows are compared exactly."""
    monkeypatch.setattr(m.Repeated, "__call__", lambda self, least: np.ones(len(least), dtype=bool))
    rows = rows_with_passages(random.Random(9), 60, 10)
    assert sorted((tuple(r) for r in m.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=10).collect()), key=repr) == plain(rows, 10)


def test_sketch_never_underestimates(spark):
    rows = rows_with_passages(random.Random(4), 100, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for cells in (m.SHARD_CELLS, 4 * m.SHARD_CELLS):
        known = m.sketch(docs, cells, 10)
        seen = {}
        import pyarrow as pa

        from tidewatch.llm.textblocks import blocks

        for k, (_, text) in enumerate(rows):
            for block in blocks(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])):
                for x in np.unique(m.minimisers(block, block.word_hashes(), 10)[1]).tolist():
                    seen.setdefault(x, set()).add(k)
        twice = np.array([x for x, k in seen.items() if len(k) > 1], dtype=U64)
        once = np.array([x for x, k in seen.items() if len(k) == 1], dtype=U64)
        assert known(twice).all() and known(once).mean() < 0.2


def test_empty(spark):
    assert m.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
