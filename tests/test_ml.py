import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, models, ordered, prep

INF = float("inf")


def test_labels(spark):
    raw = {
        "DoS Hulk": "DoS", "Heartbleed": "DoS", "FTP-Patator": "BruteForce", "Web Attack � XSS": "WebAttack",
        " Bot ": "Botnet", "web brute force": "WebAttack", "nonsense": "BENIGN", "Sql?": "WebAttack",
    }
    df = spark.createDataFrame([(k,) for k in raw], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", prep.class_label(F.col("raw"))).collect()} == raw


def test_repair_per_file(spark):
    rows = [("a", 1.0, None), ("a", INF, None), ("a", 5.0, None), ("b", -INF, 2.0), ("b", 3.0, float("nan")), ("b", None, 4.0)]
    df = spark.createDataFrame(rows, "file string, x double, y double")
    got = sorted(tuple(r) for r in prep.repair(df, ["x", "y"]).collect())
    assert got == [("a", 1.0, 0.0), ("a", 5.0, 0.0), ("a", 5.0, 0.0), ("b", 3.0, 2.0), ("b", 3.0, 4.0), ("b", 3.0, 4.0)]


def test_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(i, "BENIGN" if i % 10 else "DoS") for i in range(1003)], "id long, label string")
    got = prep.stratified_split(df, "id").groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert {r["label"]: r["t"] for r in got.collect()} == {"BENIGN": math.ceil(902 * 0.2), "DoS": math.ceil(101 * 0.2)}


def test_scale_constant_and_outside(spark):
    train = spark.createDataFrame([(0.0, 7.0), (10.0, 7.0)], "a double, b double")
    got = prep.scale(spark.createDataFrame([(20.0, 8.0)], "a double, b double"), prep.minmax(train, ["a", "b"]), ["a", "b"])
    assert tuple(got.first()) == (2.0, 1.0)


def test_sequences_skip_short_classes(spark):
    rows = [("nine", i) for i in range(9)] + [("ten", i) for i in range(10)] + [("big", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "label string, pos long").withColumn("chunk", F.floor(F.col("pos") / 13))
    got = prep.sequences(df, "label", "chunk", ["pos"], F.col("pos")).collect()
    assert sorted((r["label"], r["start"]) for r in got) == sorted([("ten", 0)] + [("big", s) for s in range(0, 991, 5)])
    assert all(r["items"] == list(range(r["start"], r["start"] + 10)) for r in got)
    stats = {r["label"]: (r["sequences"], r["skipped"]) for r in prep.sequence_stats(df, "label").collect()}
    assert stats == {"nine": (0, True), "ten": (1, False), "big": (199, False)}


def test_guard(spark):
    rows = [(0, None), (1, [1.0] * 40), (2, [0.0] * 41), (3, [0.0] * 40 + [1.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    assert [r[0] for r in df.orderBy("i").select(prep.guard(F.col("v"))).collect()] == ["zero_vector", "wrong_shape", "zero_vector", None]


def test_threshold_prediction(spark):
    df = spark.createDataFrame([([0.3, 0.4, 0.3],), ([0.2, 0.9, 0.1],), ([0.9, 0.1, 0.0],)], "p array<double>")
    name, conf = metrics.predict_thresholds(F.col("p"), [0.5, 0.5, 0.5], ["BENIGN", "X", "Y"])
    assert [tuple(r) for r in df.select(name, conf).collect()] == [("BENIGN", 0.0), ("X", 0.9), ("BENIGN", 0.0)]
    name, conf = metrics.predict_argmax(F.col("p"), ["BENIGN", "X", "Y"])
    assert [tuple(r) for r in df.select(name, conf).collect()] == [("X", 0.4), ("X", 0.9), ("BENIGN", 0.9)]


def test_roc_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.random(400).round(2)
    y = rng.random(400) < p
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "p double, y boolean")
    auc = metrics.roc_auc(metrics.roc_points(df, []), []).first()[0]
    pos, neg = p[y], p[~y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc == pytest.approx(want)


def test_macro_auc_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows, curves = [], []
    for c in ("a", "b", "c"):
        p, y = rng.random(150).round(2), rng.random(150) < 0.3
        rows += [(c, float(a), bool(b)) for a, b in zip(p, y)]
        pts = [(0.0, 0.0, 0, 0)]
        for t in sorted(set(p), reverse=True):
            k = p >= t
            pts.append((np.sum(k & ~y) / np.sum(~y), np.sum(k & y) / np.sum(y), np.sum(k & ~y), np.sum(k & y)))
        steps = np.diff([(q[2], q[3]) for q in pts], axis=0)
        keep = [True] + [i == len(pts) - 1 or i == 1 or tuple(steps[i - 1]) != tuple(steps[i]) for i in range(1, len(pts))]
        curves.append([q for q, k in zip(pts, keep) if k])
    axis = np.unique(np.concatenate([[q[0] for q in c] for c in curves]))
    mean = sum(np.interp(axis, [q[0] for q in c], [q[1] for q in c]) for c in curves) / 3
    df = spark.createDataFrame(rows, "class string, p double, y boolean")
    got = metrics.macro_auc(metrics.drop_collinear(metrics.roc_points(df)), 3).first()[0]
    assert got == pytest.approx(np.sum(np.diff(axis) * (mean[1:] + mean[:-1]) / 2))


def test_forest_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = np.where(x[:, 0] > 0.8, "DoS", "BENIGN")
    df = spark.createDataFrame([(float(a), float(b), str(c)) for (a, b), c in zip(x, y)], "a double, b double, label string")
    model = models.train_forest(df, ["a", "b"], trees=10, depth=5)
    m = models.scored_metrics(models.forest_probabilities(model, df, ["a", "b"])).first()
    assert m["accuracy"] > 0.97


def test_anomaly_forest_finds_outliers(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(1500, 3)), rng.normal(8, 1, size=(30, 3))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    forest = models.train_anomaly_forest(df.filter("id < 1500"), cols, "id")
    trees = forest.collect()
    assert len(trees) == 100 and all(r["n"] == 256 for r in trees)
    scored = models.anomaly_scores(df, forest, cols)
    offset = models.contamination_offsets(scored.filter("id < 1500"), [0.01])
    out = models.decision(scored, offset)
    flagged = {r["id"] for r in out.filter("raw_score < 0").collect()}
    assert set(range(1500, 1530)) <= flagged and len(flagged & set(range(1500))) <= 20


def test_alert_evaluation(spark):
    truth = spark.createDataFrame([("1", "DoS"), ("2", "DoS"), ("3", "BENIGN"), ("4", "BENIGN")], "flow_id string, label string")
    alert = spark.createDataFrame([("a", "1", "PortScan", 1), ("b", "3", "DoS", 1)], "alert_id string, flow_id string, attack_type string, t_us long")
    j = metrics.evaluate_alerts(truth, alert)
    s = metrics.alert_scores(j).first()
    assert (s["class"], s["tpr"], s["precision"], s["f1"]) == ("DoS", 0.5, 1.0, 0.667)
    assert metrics.alert_summary(j).first()["fpr"] == 0.5


def test_source_windows_on_hot_source(spark):
    rows = [("hot", i, i) for i in range(2500)] + [("x", i, 5000 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "src string, t long, id long").withColumn("c", ordered.time_chunk("t", 100))
    out = {r["id"]: r for r in prep.source_windows(df, "src", "c", ["t", "id"], F.col("id")).collect()}
    assert len(out) == 2504 and out[2400]["recent"] == list(range(2391, 2401)) and out[2400]["window_complete"]
    assert out[1003]["recent"] == list(range(994, 1004)) and not out[5003]["window_complete"]
