"""Quality rules: counts and repeats against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op1_quality as q
from tidewatch.llm.textblocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)

    def covered(width):
        runs = [tuple(words[i : i + width]) for i in range(n - width + 1)]
        times = Counter(runs)
        return len({i + j for i, r in enumerate(runs) if times[r] > 1 for j in range(width)})

    longest = next((w for w in range(n - 1, 0, -1) if len({tuple(words[i : i + w]) for i in range(n - w + 1)}) < n - w + 1), 0)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(3), "covered_words": covered(q.MIN_RUN), "longest_repeat": longest,
    }


TEXTS = [
    None, "", "   \n\t ", "a", "a a a a a a a a a a a a a a", "one two three one two three", "x\x0by\x0cz\x1cw v u",
    "é#ü |<b>| 日本 日本\nline\nline\n\nline \n", " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(20, 45)),
    "\n".join(["same line of words here"] * 30), " ".join("ab"[int(c)] for c in bin(0x5A5A7F3C1E)[2:] * 4), "x" * 5000,
]


@pytest.mark.parametrize("text", TEXTS + ["q " * 300 + "r"])
def test_counts(text):
    batch = pa.RecordBatch.from_arrays([pa.array([None, text, "q q q", text], pa.string())], ["text"])
    for block in blocks(batch):
        got = q.measure(block)
        for k, v in plain(text).items():
            assert got[k].tolist() == [0, v, plain("q q q")[k], v], k


def test_random_texts_in_blocks():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 40))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(10)
    parts = [q.measure(b) for b in blocks(batch)]
    for k in parts[0]:
        assert np.concatenate([p[k] for p in parts]).tolist() == [plain(t)[k] for t in texts[10:]]


def test_suffix_array_is_sorted():
    tokens = np.array([2, 1, 2, 1, 2, 1, 1], dtype=np.uint64)
    order, common = q.suffix_array(tokens, np.full(7, 7))
    suffixes = [tuple(tokens[i:]) for i in range(7)]
    assert order.tolist() == sorted(range(7), key=lambda i: suffixes[i])
    for a, b, n in zip(order, order[1:], common):
        assert suffixes[a][:n] == suffixes[b][:n] and suffixes[a][n : n + 1] != suffixes[b][n : n + 1]


def test_verdict_and_strange_rows(spark):
    repeated = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame(
        [(1, None, 5), (2, repeated, 5), (2, repeated, 5), (None, repeated + " " + repeated, 5), (4, " ".join(f"v{i}" for i in range(400)) + " " + repeated + " " + repeated, 5)],
        "doc_id long, text string, n_words int",
    )
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in q.quality(docs).collect()}
    assert got == {(1, 0): (True, False), (2, 100): (False, True), (None, 200): (True, False), (4, 600): (False, False)}
    assert q.quality(docs).count() == 5
    assert q.quality(docs.where(F.lit(False))).collect() == []
