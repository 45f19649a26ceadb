import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rules
from tidewatch.sources import tables

LINES = [
    "# comment", "", "not a rule at all",
    'alert tcp any any -> any 80 (msg:"no id"; content:"x";)',
    'alert tcp any any -> any 80 (msg:"Union probe"; content:"UNION"; content:"SELECT"; nocase; classtype:web-application-attack; sid:1; rev:2;)',
    'alert tcp any any -> any any (msg:"Sweep"; flags:S; threshold: type both, track by_src, count 3, seconds 10; classtype:network-scan; sid:2;)',
    'alert icmp any any -> any any (msg:"Ping"; itype:8; priority:1; sid:3;)',
    'alert tcp any 21 -> any any (msg:"Sleep call"; content:"SLEEP("; nocase; sid:4;)',
    'alert tcp any any -> any any (msg:"Null scan"; flags:0; classtype:attempted-admin; sid:5;)',
    'alert tcp any any -> any any (msg:"eval() seen"; content:"eval("; pcre:"/ev[a]l/i"; sid:6;)',
]
PACKETS = "packet_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flag_bits int, payload binary, icmp_type int"


@pytest.fixture(scope="module")
def table(spark):
    return rules.parse_rules(spark.createDataFrame(list(enumerate(LINES)), "rule_order long, raw string")).cache()


def pkt(i, proto="TCP", port=80, bits=16, payload=None, t=0, src="1.1.1.1", icmp=None):
    return (i, t, src, "2.2.2.2", 1000, port, proto, bits, payload, icmp)


def test_parse(table):
    got = {r["rule_id"]: r for r in table.collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5", "6"]
    assert got["1"]["content_patterns"] == ["UNION", "SELECT"] and got["1"]["nocase"] and got["1"]["rev"] == 2
    assert got["1"]["class_severity"] == "High" and got["5"]["class_severity"] == "Critical"
    assert got["2"]["class_severity"] == "Medium" and got["3"]["class_severity"] == "Critical"
    assert got["4"]["class_severity"] == "Medium" and got["4"]["content_patterns"] == ["SLEEP("]
    assert got["4"]["src_port"] == "21" and got["3"]["itype"] == 8 and got["5"]["flags"] == "0"
    r = got["2"]
    assert (r["threshold_type"], r["threshold_track"], r["threshold_count"], r["threshold_seconds"]) == ("both", "by_src", 3, 10)
    assert got["6"]["pcre"] == ["/ev[a]l/i"]


def test_matching(spark, table):
    data = [
        pkt(1, payload=b"x union all SeLeCt y"), pkt(2, payload=b"union only"), pkt(3, bits=2), pkt(4, bits=18),
        pkt(5, "ICMP", None, 0, icmp=8), pkt(6, "ICMP", None, 0, icmp=0), pkt(7, bits=0), pkt(8, payload=b"EVAL( eval("),
        pkt(9, port=443, payload=b"union select"), pkt(10, payload=b"sleep(1)"),
    ]
    df = spark.createDataFrame(data, PACKETS)
    got = {}
    for r in rules.all_matches(df, table).collect():
        got.setdefault(r["packet_id"], []).append(r["rule_id"])
    assert got == {1: ["1"], 3: ["2"], 5: ["3"], 7: ["5"], 8: ["6"], 10: ["4"]}
    headed = rules.all_matches(df, table, headers=True).filter("packet_id = 10")
    assert headed.count() == 0
    first = {r["packet_id"]: (r["matched"], r["sig_confidence"]) for r in rules.first_match(df, table).collect()}
    assert len(first) == 10 and first[1] == (True, 1.0) and first[2] == (False, 0.0)


def test_many_rules_with_sparse_and_missing_orders(spark):
    protos = ["tcp", "any", "sctp"]
    lines = [
        (None if i % 7 == 0 else i * 1_000_003, f'alert {protos[i % 3]} any any -> any {"any" if i % 5 else 80 + i % 2} (msg:"m{i}"; content:"w{i % 50};"; sid:{i};)')
        for i in range(3000)
    ]
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    data = [pkt(1, payload=b"w3; w4; w17;"), pkt(2, "SCTP", 81, payload=b"w8;"), pkt(3, "GRE", None, payload=b"w1;"), pkt(4, None, 80, payload=b"w1;")]
    got = {}
    for r in rules.with_hits(spark.createDataFrame(data, PACKETS), t).collect():
        got[r["packet_id"]] = [h["rule_id"] for h in r["hits"]]
    want = {}
    for i, _, _, _, _, port, proto, _, payload, _ in data:
        hits = [
            k for k in range(3000)
            if protos[k % 3] in ("any", (proto or "").lower()) and (k % 5 or port == 80 + k % 2) and f"w{k % 50};".encode() in payload
        ]
        want[i] = [str(k) for k in sorted(hits, key=lambda k: (k % 7 == 0, k if k % 7 else str(k)))]
    assert got == want and all(want.values())
    first = {r["packet_id"]: r["rule_id"] for r in rules.first_match(spark.createDataFrame(data, PACKETS), t).collect()}
    assert first == {i: h[0] for i, h in want.items()}


def test_grammar(spark):
    lines = [
        'alert tcp any any -> any any(msg:"no blank"; sid:1;)',
        '\talert  udp any any  <> any any ( msg : "a; b (c)" ; content:"x;y"; PCRE:"/a;b/is"; sid : 2 ; rev:7 )  ',
        "alert tcp any any => any any (sid:3;)",
        "alert tcp any any -> any (sid:4;)",
        'alert tcp any any -> any any (msg:"open"; sid:5;',
        'alert tcp any any -> any any (msg:"t"; threshold:type limit,track by_dst , count 3,seconds 9; sid:6;)',
        'alert tcp any any -> any any (msg:"t"; threshold:type limit, count 3; sid:7;)',
        'alert tcp any any -> any any (msg:""; sid:8;)',
        'alert tcp any any -> any any (msg:"x"; sid:no9;)',
        'alert tcp any any -> any any (msg:"a) b"; sid:10;)',
        "alert tcp any any -> any any",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "rule_order long, raw string")
    got = {r["rule_id"]: r for r in rules.parse_rules(df).collect()}
    assert set(got) == {"1", "2", "5", "6", "7", "8", "no9", "10"}
    assert (got["2"]["name"], got["2"]["content_patterns"], got["2"]["pcre"], got["2"]["rev"], got["2"]["direction"]) == ("a; b (c)", ["x;y"], ["/a;b/is"], 7, "<>")
    assert [got["6"][f"threshold_{k}"] for k in ("type", "track", "count", "seconds")] == ["limit", "by_dst", 3, 9]
    assert got["7"]["threshold_type"] is None and got["1"]["name"] == "no blank"
    assert {r["rule_id"] for r in rules.rule_records(df).collect()} == {"1", "2", "6", "7"}


def test_lists_with_mixed_negation_and_pattern_modifiers(spark):
    ports = ["[80,!443]", "![80,443]", "!80", "[!80,!81]", "[1:100,!80]", "![80,!81]"]
    lines = [(i, f'alert tcp any any -> any {p} (msg:"m"; sid:{i};)') for i, p in enumerate(ports)]
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    df = spark.createDataFrame([pkt(p, port=p) for p in (79, 80, 81, 443)], PACKETS)
    got = {}
    for r in rules.all_matches(df, t, headers=True).collect():
        got.setdefault(ports[int(r["rule_id"])], set()).add(r["packet_id"])
    assert got == {"[80,!443]": {80}, "![80,443]": {79, 81}, "!80": {79, 81, 443}, "[!80,!81]": {79, 443}, "[1:100,!80]": {79, 81}, "![80,!81]": {79, 81, 443}}
    lines = [(0, 'alert tcp any any -> any any (msg:"s"; pcre:"/^a.b$/sm"; sid:1;)'), (1, 'alert tcp any any -> any any (msg:"i"; pcre:"/A.B/i"; sid:2;)'), (2, 'alert tcp any any -> any any (msg:"p"; pcre:"/a.b/"; sid:3;)')]
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    df = spark.createDataFrame([pkt(1, payload=b"x\na\nb\ny"), pkt(2, payload=b"xa-bx")], PACKETS)
    assert sorted((r["packet_id"], r["rule_id"]) for r in rules.all_matches(df, t).collect()) == [(1, "1"), (2, "2"), (2, "3")]


def test_rate_on_a_flooding_source(spark, table):
    """One source with most of the rows; brute force over time order."""
    times = sorted([i * 137_000 % 40_000_000 for i in range(400)] + [5_000_000] * 5)
    data = [pkt(i, bits=2, t=t, src="9.9.9.9") for i, t in enumerate(times)]
    data += [pkt(1000 + i, bits=2, t=i * 30_000_000, src="8.8.8.8") for i in range(4)]
    df = spark.createDataFrame(data, PACKETS)
    out = rules.rate_alerts(rules.all_matches(df, table), table, slice_rows=100)
    want, anchor = [], None
    for i, t in enumerate(times):
        n = sum(1 for x in times if t - 10_000_000 <= x <= t)
        if n >= 3 and (anchor is None or t > anchor + 10_000_000):
            anchor = t
            want.append(("9.9.9.9", t))
    assert sorted((r["tracked"], r["t_us"]) for r in out.collect()) == want


def test_addresses_and_ports(spark):
    lines = [
        (0, 'alert tcp 1.1.0.0/16 any -> any [80,8000:8010] (msg:"a"; sid:1;)'),
        (1, 'alert tcp !1.1.0.0/16 any -> any any (msg:"b"; sid:2;)'),
        (2, 'alert tcp 2.2.2.2 80 <> 1.1.1.1 any (msg:"c"; sid:3;)'),
        (3, 'alert tcp any any -> any !80 (msg:"d"; sid:4;)'),
    ]
    t = rules.parse_rules(spark.createDataFrame(lines, "rule_order long, raw string"))
    df = spark.createDataFrame([pkt(1), pkt(2, port=8005), pkt(3, port=81, src="3.3.3.3")], PACKETS)
    got = sorted((r["packet_id"], r["rule_id"]) for r in rules.all_matches(df, t, headers=True).collect())
    assert got == [(1, "1"), (1, "3"), (2, "1"), (2, "4"), (3, "2"), (3, "4")]


def test_rule_directory(spark, tmp_path):
    (tmp_path / "port_scan.rules").write_text('alert tcp any any -> any any (msg:"x"; sid:7;)\n# sid: in a comment\n')
    (tmp_path / "dos.rules").write_text('# head\nalert tcp any any -> any any (msg:"y flood"; sid:8;)\n')
    (tmp_path / "readme.txt").write_text("sid:1")
    lines = tables.read_rule_lines(spark, str(tmp_path))
    got = rules.parse_rules(lines, "category").orderBy("rule_order").collect()
    assert [(r["rule_id"], r["attack_category"], r["severity"]) for r in got] == [
        ("8", "Dos", "CRITICAL"), ("7", "Port Scan", "MEDIUM"),
    ]
    kinds = rules.attack_class(F.col("attack_category"))
    assert [r[0] for r in rules.parse_rules(lines, "category").orderBy("rule_order").select(kinds).collect()] == ["DoS", "PortScan"]
    assert {r["file"]: r["rules"] for r in tables.rules_per_file(lines).collect()} == {"dos.rules": 1, "port_scan.rules": 1}
