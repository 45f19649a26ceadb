"""Recall against brute force; exact scores, order and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op10_forest as m


def plain(rows, query, nearest=5):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    if query not in ok:
        return []
    q = ok[query] / np.abs(ok[query]).max()
    score = {}
    for i, v in ok.items():
        if i != query and len(v) == len(q):
            v = v / np.abs(v).max()
            score[i] = float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())))
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:nearest]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).repartition(4)
    out = {}
    for r in m.search(df, F.col("id") % 50 == 0, **more).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
@pytest.mark.parametrize("block_rows", [100, 8192])
def test_recall(spark, kind, block_rows):
    rng = np.random.default_rng(1)
    n, d = 1500, 24
    x = rng.standard_normal((n, d))
    if kind == "clusters":
        x = rng.standard_normal((40, d))[rng.integers(0, 40, n)] + 0.1 * x
    if kind == "copies":
        x[: n // 3] = x[0]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, block_rows=block_rows)
    hits = total = 0
    for q in range(0, n, 50):
        want = plain(rows, q)
        exact = dict(plain(rows, q, n))
        assert [k for k, _ in got[q]] == [k for k, _ in sorted(got[q], key=lambda e: (-e[1], e[0]))] and len(got[q]) == 5
        assert all(s == pytest.approx(exact[k], abs=1e-14) for k, s in got[q])
        hits += len({k for k, _ in got[q]} & {k for k, _ in want})
        total += 5
        if kind == "copies" and q < n // 3:
            assert [k for k, _ in got[q]] == [k for k, _ in want]
    assert hits / total >= 0.93


def test_strange_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]),
            (None, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [1e300, 1e300]), (1, [2.0, 0.0]), (150, [5e-324, 0.0])]
    got = run(spark, rows)
    once = [*dict(rows).items()]
    assert set(got) == {0, 100, 150}
    for q, found in got.items():
        want = plain(once, q)
        assert [k for k, _ in found] == [k for k, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])
    assert run(spark, [(1, [1.0])]) == {} and run(spark, [(50, [1.0])]) == {}
    assert m.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect() == []
