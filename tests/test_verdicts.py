import itertools

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import correlate, ensemble

T0 = 1_700_000_000_000_000


@pytest.mark.parametrize("sep", [0])
def test_vote(spark, sep):
    """sig, rf, lstm, anomaly confidences -> score, alert, severity, type, detected_by."""
    cases = [
        ("a", 1.0, "DoS", 0.99, "DoS", 0.97, 0.80, True, 0.972, True, "CRITICAL", "DoS", "both"),
        ("b", 1.0, "PortScan", 0.95, "PortScan", None, None, True, 0.7325, True, "MEDIUM", "PortScan", "both"),
        ("c", None, None, 0.45, "Botnet", 0.95, None, True, 0.3, False, "NONE", "Botnet", "ml"),
        ("d", None, None, 0.30, "DoS", 0.70, 0.80, True, 0.29, False, "NONE", "DoS", "ml"),
        ("e", 1.0, "BruteForce", 0.79, "BruteForce", None, None, True, 0.6765, True, "LOW", "BruteForce", "both"),
        ("f", 1.0, "DoS", 0.90, "PortScan", None, None, True, 0.715, True, "MEDIUM", "DoS", "both"),
        ("g", None, None, None, None, None, 1.0, True, 0.10, False, "NONE", "ANOMALY", "ml"),
        ("h", 1.0, "DoS", 1.0, "DoS", 1.0, 1.0, True, 1.0, True, "CRITICAL", "DoS", "both"),
        ("i", 1.0, "DoS", None, None, 1.0, None, False, 0.40, False, "NONE", "DoS", "signature"),
        ("j", None, None, None, None, None, None, True, 0.0, False, "NONE", "BENIGN", "none"),
    ]
    flows = spark.createDataFrame([(c[0],) for c in cases], "flow_id string")
    sig = spark.createDataFrame(
        [(c[0], True, "R", c[2], c[1]) for c in cases if c[1]],
        "flow_id string, matched boolean, rule_id string, attack_type string, confidence double",
    )
    rf = spark.createDataFrame(
        [(c[0], c[4], c[3], True) for c in cases if c[3]],
        "flow_id string, predicted_class string, confidence double, is_attack boolean",
    )
    lstm = spark.createDataFrame(
        [(c[0], "DDoS", c[5], True, c[7]) for c in cases if c[5]],
        "flow_id string, predicted_class string, confidence double, is_attack boolean, window_complete boolean",
    )
    anomaly = spark.createDataFrame(
        [(c[0], True, c[6]) for c in cases if c[6]], "flow_id string, is_anomaly boolean, confidence double"
    )
    out = ensemble.verdicts(ensemble.combine(flows, sig, rf, lstm, anomaly)).collect()
    got = {r["flow_id"]: (r["score"], r["alert"], r["severity"], r["attack_type"], r["detected_by"]) for r in out}
    assert got == {c[0]: tuple(c[8:]) for c in cases}
    engines = {r["flow_id"]: r["contributing_engines"] for r in out}
    assert engines["a"] == ["signature", "rf", "lstm", "isolation_forest"] and engines["i"] == ["signature"]


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError, match="sum to 1"):
        ensemble.score(None, None, None, None, {"sig": 0.5, "rf": 0.5, "lstm": 0.1, "if": 0.1})


def test_severity_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.6999, 0.7, 0.85, 0.95)], "v double")
    assert [r[0] for r in df.select(ensemble.severity(F.col("v"))).collect()] == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def events(spark, items):
    data = [
        (i, f"f{i}", round(T0 + s * 1e6), src, dst, kind, sev) for i, (s, src, dst, kind, sev) in enumerate(items)
    ]
    return spark.createDataFrame(
        data, "event_id long, flow_id string, t_us long, src_ip string, dst_ip string, attack_type string, severity string"
    )


def ev(s, kind="DoS", src="a", dst="b", sev="LOW"):
    return (s, src, dst, kind, sev)


@pytest.mark.parametrize(
    ("offsets", "emitted", "dups"),
    [
        ([0, 30], [0], [1]), ([0, 1, 2, 3], [0], [3]), ([0, 60, 60.001], [0, 2], [1, 0]),
        ([0, 50, 100, 150], [0, 2], [1, 1]), ([0, 60.000001], [0, 1], [0, 0]),
    ],
)
def test_duplicates(spark, offsets, emitted, dups):
    out = correlate.deduplicate(events(spark, [ev(s) for s in offsets])).orderBy("event_id").collect()
    assert [r["event_id"] for r in out] == emitted and [r["dup_count"] for r in out] == dups


def test_other_keys_are_not_duplicates(spark):
    e = events(spark, [ev(0), ev(0, kind="PortScan"), ev(0, src="x"), ev(0, dst="y")])
    assert correlate.deduplicate(e).count() == 4


def test_groups_and_chains(spark):
    e = events(
        spark,
        [
            ev(0, "PortScan", sev="MEDIUM"), ev(60, "BruteForce", sev="CRITICAL"), ev(500, "PortScan", sev="LOW"),
            ev(601, "DoS"), ev(0, "DoS", src="z"), ev(100, "DoS", src="y"),
        ],
    )
    out = {r["event_id"]: r for r in correlate.correlate(e).collect()}
    assert out[0]["group_id"] == out[1]["group_id"] == out[2]["group_id"] != out[3]["group_id"]
    assert [out[i]["is_new_group"] for i in range(6)] == [True, False, False, True, True, True]
    assert [out[i]["attack_chain"] for i in range(6)] == [False, True, True, False, False, False]
    assert out[1]["chain_attack_types"] == ["BruteForce", "PortScan"]
    assert [out[i]["composite_severity"] for i in range(4)] == ["MEDIUM", "CRITICAL", "CRITICAL", "LOW"]
    g = correlate.group_summary(correlate.group(correlate.deduplicate(e)))
    big = g.filter("src_ip = 'a' AND members = 3").first()
    assert big["composite_severity"] == "CRITICAL" and big["attack_chain"]


def test_counters_balance(spark):
    e = events(spark, [ev(s, k) for s, k in itertools.product(range(0, 300, 7), ["DoS", "PortScan"])])
    marked = correlate.suppressions(e)
    grouped = correlate.group(correlate.deduplicate(e))
    c = correlate.counters(marked, grouped, T0 + 294_000_000).first()
    assert c["total_received"] == c["total_emitted"] + c["total_suppressed"] == e.count()
    assert c["chain_flags_raised"] == 1 and c["active_dedup_slots"] == 2 and c["active_correlation_groups"] == 1
    late = correlate.counters(marked, grouped, T0 + 10_000_000_000).first()
    assert late["active_dedup_slots"] == 0 and late["evicted_dedup"] == c["total_emitted"] and late["evicted_groups"] == 1


def test_links_are_neighbours_only(spark):
    e = events(spark, [ev(i * 5) for i in range(50)] + [ev(10_000, "PortScan")]).withColumn("alert_id", F.format_string("%03d", "event_id"))
    out = correlate.links(e, chunk_us=20_000_000)
    assert out.count() == 49 and {r["relation"] for r in out.collect()} == {"TEMPORAL_SEQUENCE"}


def test_coordinated(spark):
    e = events(spark, [ev(i, src=f"s{i % 4}") for i in range(40)] + [ev(1, "PortScan", src="q")])
    assert [tuple(r) for r in correlate.coordinated(e, sources=4).select("attack_type", "sources", "events").collect()] == [("DoS", 4, 40)]
