import pytest
from pyspark.sql import functions as F

from tests.test_rules import PACKETS, pkt
from tidewatch.operators import rules

PROTOS = ["tcp", "any", "sctp"]


def line(i, word):
    """Rules that differ in order and id only, rules of one word, and rules that differ in everything."""
    body = f'content:"{word}"; {"nocase; " if i % 4 == 1 else ""}' if i % 9 else ""
    return f'alert {PROTOS[i % 3]} any any -> any {"any" if i % 5 else 80 + i % 2} (msg:"m"; {body}{"flags:S; " if i % 7 == 0 else ""}sid:{i};)'


@pytest.mark.parametrize("words", [7, 300])
@pytest.mark.parametrize("matches", [rules.all_matches, rules.content_matches])
def test_many_rules(spark, words, matches):
    orders = [None if i % 11 == 0 else i % 400 for i in range(900)]
    lines = [(o, line(i, f"w{i % words};")) for i, o in enumerate(orders)]
    lines += lines[:20]  # rules given twice match twice
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    data = [pkt(1, payload=b"w3; w4; W17;"), pkt(2, "SCTP", 81, payload=b"W8;"), pkt(3, "GRE", None, payload=b"w1;"), pkt(4, None, 80, 2, b"w5;"), pkt(5, "TCP", 81, 2), pkt(5, "TCP", 81, 2)]
    got = sorted((r["packet_id"], int(r["rule_id"]), r["rule_order"] is None) for r in matches(spark.createDataFrame(data, PACKETS), t).collect())
    want = []
    for i, _, _, _, _, port, proto, bits, payload, _ in data:
        for k in [*range(900), *range(20)]:
            text = (payload.lower() if k % 4 == 1 else payload) if payload else b""
            ok = PROTOS[k % 3] in ("any", (proto or "").lower()) and (k % 5 or port == 80 + k % 2)
            ok = ok and (k % 9 == 0 or f"w{k % words};".encode() in text) and (k % 7 or (proto == "TCP" and bits == 2))
            want += [(i, k, k % 11 == 0)] if ok else []
    assert got == sorted(want) and len(want) > 50


@pytest.mark.parametrize("words", [5, 100])
@pytest.mark.parametrize("matches", [rules.all_matches, rules.content_matches])
def test_rules_alike_are_met_once(spark, words, matches):
    """Packets meet conditions, not rules: ten thousand rules of a few conditions are joined behind them, as rows."""
    lines = [(i, f'alert tcp any any -> any 80 (msg:"m"; content:"w{i % words};"; sid:{i};)') for i in range(10_000)]
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    df = spark.createDataFrame([pkt(i, payload=b"w%d;" % (i % words)) for i in range(200)], PACKETS)
    out = matches(df, t)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 200 * 10_000 // words
    assert out.groupBy("packet_id").agg(F.count_distinct("rule_id").alias("n")).filter(F.col("n") != 10_000 // words).count() == 0


def test_no_rules_with_text_and_none_at_all(spark):
    df = spark.createDataFrame([pkt(1, payload=b"a"), pkt(2)], PACKETS)
    none = rules.parse_rules(spark.createDataFrame([(0, "# note")], "rule_order long, raw string"))
    plain = rules.parse_rules(spark.createDataFrame([(0, 'alert any any any -> any any (msg:"m"; sid:1;)')], "rule_order long, raw string"))
    for matches in (rules.all_matches, rules.content_matches):
        assert matches(df, none).count() == 0 and matches(df, plain).count() == 2


def test_a_line_is_read_once(spark):
    """The options of a line stand in the plan once, not once for each column and condition that names them."""
    lines = spark.createDataFrame([(0, 'alert tcp any any -> any 80 (msg:"m"; sid:1;)'), (1, None), (2, "  ")], "rule_order long, raw string")
    for read in (rules.parse_rules, rules.rule_records):
        out = read(lines)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and [r["rule_id"] for r in out.collect()] == ["1"]
