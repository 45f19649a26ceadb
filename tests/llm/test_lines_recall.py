"""Links of lines against edit similarity alone, whatever keys the lines meet by."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_lines import distance
from tidewatch.llm import op9_lines as m


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)]


def reworded(rng, line):
    """One word replaced by a word of other letters and the same length, if the edit similarity allows it."""
    new = list(line)
    k = rng.choice([k for k, w in enumerate(line) if len(w) <= int((1 - m.EDIT_SIMILARITY) * len(" ".join(line)) + 1e-9)])
    new[k] = "".join(rng.choices("0µßþ", k=len(line[k])))
    return new


def spoiled(rng, text, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:k] + ("" if kind == 1 else rng.choice("abcdefgh")) + text[k + (kind != 2) :]
    return text.strip()


def keys_of(lines):
    parts = m.lines_of_batch([pa.RecordBatch.from_arrays([pa.array([0] * len(lines)), pa.array([0] * len(lines)), pa.array(lines)], ["doc", "text_hash", "text"])])
    (batch,) = pa.Table.from_batches(parts).combine_chunks().to_batches()
    keys, counts, whole = m.line_keys(batch)
    assert len(counts) == len(lines)
    return [set(x.tolist()) for x in np.split(keys, np.cumsum(counts)[:-1])], whole, batch.column("size").to_numpy()


def found(pairs):
    (x, a, n), (y, b, k) = keys_of([p for p, _ in pairs]), keys_of([q for _, q in pairs])
    near = (np.bitwise_count(a ^ b) <= m.DISTANCE) | (np.maximum(n, k) < m.SHORT)
    return float(np.mean([bool(p & q) and bool(ok) for p, q, ok in zip(x, y, near)]))


@pytest.mark.parametrize("n,words_changed,least", [(10, 1, 0.97), (20, 1, 0.99), (60, 1, 0.99), (20, 2, 0.9), (60, 2, 0.99), (60, 3, 0.7)])
def test_changed_words_meet(n, words_changed, least):
    rng, pairs = random.Random(n), []
    while len(pairs) < 400:
        line = words(rng, n)
        other = line
        for _ in range(words_changed):
            other = reworded(rng, other)
        if distance(" ".join(line), " ".join(other)) <= int((1 - m.EDIT_SIMILARITY) * len(" ".join(line)) + 1e-9):
            pairs.append((" ".join(line), " ".join(other)))
    assert found(pairs) >= least


@pytest.mark.parametrize("n", [10, 20, 60])
def test_dropped_word_meets(n):
    rng, pairs = random.Random(n + 1), []
    for _ in range(400):
        line = words(rng, n)
        k = min(range(n), key=lambda k: (len(line[k]), rng.random()))
        pairs.append((" ".join(line), " ".join(line[:k] + line[k + 1 :])))
    assert found(pairs) >= 0.97


@pytest.mark.parametrize("share,least", [(0.02, 0.45), (0.05, 0.12)])
def test_scattered_edits_meet(share, least):
    """Letters changed in many words: the block method's weak side, as the operator's docstring says."""
    rng, pairs = random.Random(2), []
    while len(pairs) < 600:
        text = " ".join(words(rng, rng.randint(5, 60)))
        other = spoiled(rng, text, int(share * len(text)))
        if " ".join(other.split()) == other and distance(text, other) <= int((1 - m.EDIT_SIMILARITY) * max(len(text), len(other)) + 1e-9):
            pairs.append((text, other))
    assert found(pairs) >= least


def test_short_lines_always_meet():
    rng, pairs = random.Random(3), []
    while len(pairs) < 500:
        text = "".join(rng.choices("abcé", k=rng.randint(9, 19)))
        other = spoiled(rng, text, 1)
        if distance(text, other) <= int((1 - m.EDIT_SIMILARITY) * max(len(text), len(other)) + 1e-9) and max(len(text), len(other)) < m.SHORT:
            pairs.append((text, other))
    assert found(pairs) == 1


def test_bounded_edit_distance():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(2))
        limit = rng.randint(0, 6)
        assert (m.edit_distance(a, b, limit) <= limit) == (distance(a, b) <= limit)


def test_removed_lines_by_edit_similarity(spark):
    """Ten-word lines, each with a copy in which one word is another."""
    rng = random.Random(6)
    lines = [words(rng, 10) for _ in range(100)]
    rows = [(k, " ".join(x)) for k, x in enumerate(lines)] + [(1000 + k, " ".join(reworded(rng, x))) for k, x in enumerate(lines)]
    got = {r["doc_id"] for r in m.without_double_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got <= {1000 + k for k in range(100)} and len(got) >= 99
