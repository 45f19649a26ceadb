"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op11_resampling as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngrams):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, ngrams + 1) for k in range(len(words) - n + 1)]


def plain(rows, targets, ngrams=1, buckets=m.BUCKETS, seed=m.SEED, least=m.LEAST_WORDS, percent=m.PERCENT):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in features(text, ngrams)[1])
    t = Counter(bucket(f) for text in targets for f in features(text, ngrams)[1])
    up, down = s.total() + buckets, t.total() + buckets
    out = []
    for i, text in rows:
        n, found = features(text, ngrams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * up / ((s[b] + 1) * down))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def corpus(rng):
    pool = [*"the of and a in it Über STRASSE naïve x1 42 日本語 é".split(), "long" * 30, "ÀB"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "_", "\x7f"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, " .,; "), (903, "the " * 60_000), (904, "z" * 300_000), (None, "the of and " * 20), (1, rows[1][1])]


@pytest.mark.parametrize("ngrams,buckets", [(1, m.BUCKETS), (2, 100), (3, 7)])
def test_against_plain(spark, ngrams, buckets):
    rows = corpus(random.Random(ngrams))
    targets = [None, "", "the Über of 42 in", "x1 x1 naïve the of"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = m.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), ngrams=ngrams, buckets=buckets, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, targets, ngrams, buckets, percent=30)


def test_ranks_over_slices(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE_ROWS", 40)
    rows = corpus(random.Random(9))
    got = m.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the of",)], "text string"), percent=77)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, ["the of"], percent=77)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "the of and " * 9)] * 30, "doc_id long, text string")
    got = m.resample(docs, docs, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [*range(1, 16)] and len(got) == 30


def test_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, score string, weight int, rank int, row string, id int, line int"
    docs = spark.createDataFrame([(1, "a b c " * 10, "s", 1, 2, "r", 3, 4)], schema)
    assert m.resample(docs.where(F.lit(False)), docs).collect() == []
    got = m.resample(docs, docs.where(F.lit(False)), percent=100, keep=[F.col("score"), F.col("rank"), F.col("line")])
    (row,) = got.collect()
    assert row["rank"] == 1 and row["row"]["score"] == "s" and row["n_words"] == 30 and got.columns == ["doc_id", "row", "n_words", "n_features", "weight", "score", "rank"]


def test_crc_columns():
    rng = random.Random(3)
    for length in (0, 1, 2, 7, 64):
        rows = np.array([[rng.randrange(256) for _ in range(length)] for _ in range(50)], dtype=np.uint8).reshape(50, length)
        assert m.crc_columns(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


def test_distinct_rows_with_equal_hashes():
    rows = np.array([[1, 2], [3, 4], [1, 2]], dtype=np.uint8)
    first, each = m.distinct_rows(rows, np.zeros(3, dtype=np.uint64))
    assert (rows[first][each] == rows).all() and len(first) == 2
