"""Fuzzy lines against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_linking import union
from tidewatch.llm import op9_lines as m


def normal(line):
    return " ".join(w for w in re.split(r"[\x09-\x0d\x20-/:-@\[-`{-~]+", re.sub("[0-9]", "0", line.lower())) if w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def links(forms):
    """Pairs by edit similarity alone. Their sizes and counts of letters spare most pairs the table."""
    size = np.array([len(x) for x in forms])
    letters = {c: k for k, c in enumerate(sorted({c for x in forms for c in x}))}
    counts = np.zeros((len(forms), len(letters)), dtype=np.int32)
    for k, x in enumerate(forms):
        for c, n in Counter(x).items():
            counts[k, letters[c]] = n
    out = []
    for b in range(len(forms)):
        most = ((1 - m.EDIT_SIMILARITY) * np.maximum(size[:b], size[b]) + 1e-9).astype(int)
        gap = counts[:b] - counts[b]
        maybe = (np.maximum(gap, 0).sum(axis=1) <= most) & (np.maximum(-gap, 0).sum(axis=1) <= most)
        out += [(a, b) for a in np.flatnonzero(maybe).tolist() if m.edit_distance(forms[a], forms[b]) <= most[a]]
    return out


def plain(rows):
    """Kept lines by edit similarity alone, whatever the operator meets by."""
    first = {}
    last = 1 << 63
    for i, text, *_ in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        for k, line in enumerate((text or "").split("\n")):
            if normal(line):
                first.setdefault(normal(line), (last if i is None else i, k))
    forms = sorted(first, key=first.get)
    edges = links(forms)
    group = {k: k for k in range(len(forms))} | union(edges)
    keep = {x: first[forms[group[k]]] for k, x in enumerate(forms)}
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        left = [x for k, x in enumerate(lines) if not normal(x) or keep[normal(x)] == (last if i is None else i, k)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr), edges


def rows_with_lines(rng):
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 60))) for _ in range(40)]
    pool += [x.replace(x.split()[3], "changed", 1) for x in pool[:20]] + [x[:-1] for x in pool[10:25]]
    pool += ["Page 12 of 300!", "page 34 of 999.", "", "   ", "***", "Ünïcode LÍNE", "ünïcode líne", "a", "b"]
    out = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8))), "k") for i in rng.sample(range(1000), 70)]
    out += [(2000 + i, "the very common line of all", "k") for i in range(60)]
    return out + [(None, "the very common line of all\nonly here", "k"), (5000, None, "k"), (5001, "", "k"), (5002, "\n\n", "k"), (5003, "long " * 3000 + "\nlong " * 2, "k")]


def test_against_plain(spark):
    rows = rows_with_lines(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("hash", F.lit(1)).repartition(5)
    got = m.without_double_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "hash", "n_lines", "n_removed"]
    want, edges = plain(rows)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == want
    assert len(edges) >= 5


def test_blocks_agree_by_pigeonhole():
    """Lines whose words differ in up to four classes share a key."""
    rng = random.Random(1)
    near = np.zeros(2, dtype=m.NEAR)
    for _ in range(300):
        near["letters"] = 10
        near["blocks"][0] = [rng.getrandbits(32) for _ in range(m.CLASSES)]
        near["blocks"][1] = near["blocks"][0]
        for k in rng.sample(range(m.CLASSES), rng.randint(0, 4)):
            near["blocks"][1][k] = rng.getrandbits(32)
        key, counts = m.block_keys(near)
        assert counts.all() and set(key[0].tolist()) & set(key[1].tolist())
    near["letters"][:, 1:] = 0  # one class alone: one key
    _, counts = m.block_keys(near)
    assert counts.sum(axis=1).tolist() == [1, 1]


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y z\nq"), (1, "x y z\nq"), (2, "X, y z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in m.without_double_lines(docs).collect()) == [(1, "x y z\nq", 2, 0), (1, "x y z\nq", 2, 0), (2, "", 1, 1)]
    assert m.without_double_lines(docs.where(F.lit(False))).collect() == []


def test_very_long_text(spark):
    """A text larger than a block, with lines of its own, and lines that it shares with another but for a word."""
    rng = random.Random(2)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(12)) for _ in range(12_000)]
    other = [x.replace(x.split()[2], "changed", 1) if len(x.split()[2]) <= 6 else x for x in lines[50:150]]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other) + "\nof its own")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.without_double_lines(docs).collect()}
    assert got[1]["text"] == "\n".join(lines) and (got[1]["n_lines"], got[1]["n_removed"]) == (12_000, 0)
    assert got[2]["text"].endswith("of its own") and got[2]["n_removed"] >= 95


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b\na b", 9, 8, "x", 7, "y")], "doc_id long, text string, n_lines int, n_removed int, line string, size int, near string")
    (row,) = m.without_double_lines(docs).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b", "line": "x", "size": 7, "near": "y", "n_lines": 2, "n_removed": 1}


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choices("abcé日", k=rng.randint(0, 12)))
        b = "".join(rng.choices("abcé日", k=rng.randint(0, 12))) if rng.random() < 0.5 else a[: rng.randint(0, 9)] + "x" + a[rng.randint(0, 9) :]
        assert m.edit_distance(a, b) == distance(a, b)
    long = "".join(rng.choices("abcdef ", k=30000))
    assert m.edit_distance(long, long[:100] + "zz" + long[101:20000] + long[20003:]) == 5


def test_bitmaps_lose_no_link():
    rng = random.Random(8)
    for _ in range(1000):
        a = "".join(rng.choices("abcé日 ", k=rng.randint(0, 90)))
        b = a
        for _ in range(rng.randint(0, 6)):
            k, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b = b[:k] + ("" if kind == 1 else rng.choice("abcx")) + b[k + (kind != 2) :]
        for x, y in zip(m.gram_bits(a, [1, 60, 400]), m.gram_bits(b, [1, 60, 400])):
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= 2 * m.GRAM * m.edit_distance(a, b)
    assert [x.nbytes * 8 for x in m.gram_bits("日本" * 20_000, [0, 60, 40_000])] == [256, 512, m.MOST_BITS]


def test_frequent_words_in_common_make_few_pairs(spark, monkeypatch):
    """Lines that hold the same frequent words, and others besides, are not compared by the square of their number."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    lines = [f"there were many other things about which {word()} {word()}" for _ in range(400)]
    pairs, linked = [], m.linked

    def counted(members, verify, across, name):
        def count(open_):
            out = across(open_)
            pairs.append((open_.count(), out.count()))
            return out

        return linked(members, verify, count, name)

    monkeypatch.setattr(m, "linked", counted)
    out = m.without_double_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert out.where("n_removed > 0").count() == 0
    ((rows, found),) = pairs
    assert rows >= 400 and found <= 400


def test_many_tables_at_a_time(monkeypatch):
    """The same verdict as one by one, with bands of one number and of several, for whatever similarity."""
    rng = random.Random(10)
    left, right = ["", "", "a", "x" * 900], ["", "b", "a", "y" * 900]
    for _ in range(400):
        a = "".join(rng.choices("abcdé日 ", k=rng.choice([5, 40, 200, 700])))
        b = a
        for _ in range(rng.choice([0, 1, 4, 20, 60, 90])):
            k, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b = b[:k] + ("" if kind == 1 else rng.choice("abcx")) + b[k + (kind != 2) :]
        left.append(a)
        right.append(b)
    monkeypatch.setattr(m, "BAND_CELLS", 1 << 14)
    for similarity in (0.9, 0.97, 0.6):
        most = [int((1 - similarity) * max(len(p), len(q)) + 1e-9) for p, q in zip(left, right)]
        want = [m.edit_distance(p, q) <= k for p, q, k in zip(left, right, most)]
        assert m.near_pairs(left, right, similarity).tolist() == want and 40 < sum(want) < len(want)
    assert m.near_pairs([], [], 0.9).tolist() == []
