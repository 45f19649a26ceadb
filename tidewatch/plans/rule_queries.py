"""Signature rules over the given tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rules
from tidewatch.plans import adapters as ad
from tidewatch.plans.catalog import ORACLES, register
from tidewatch.plans.flow_queries import packets

RULE_LINES = [
    ("dos", 'alert tcp any any -> any 80 (msg:"DoS error flood"; content:"error"; sid:9001; rev:1;)'),
    ("portscan", 'alert tcp any any -> any any (msg:"Port Scan SYN Sweep"; flags:S; threshold: type both, track by_src, count 3, seconds 86400; sid:9002; rev:1;)'),
    ("brute force", 'alert any any any -> any 22 (msg:"SSH Login Attempt"; content:"CLICK"; nocase; threshold: type threshold, track by_dst, count 4, seconds 172800; sid:9003;)'),
    ("dos", 'alert udp any any -> any any (msg:"UDP info"; threshold: type limit, track by_src, count 2, seconds 86400; sid:9004; rev:3;)'),
    ("portscan", 'alert icmp any any -> any any (msg:"ICMP probe"; itype:8; sid:9005;)'),
    ("webattack", 'alert tcp any any -> any 3306 (msg:"policy purchase"; content:"purchase"; content:"7"; classtype:policy-violation; sid:9006;)'),
    ("custom", 'alert tcp any any -> any any (msg:"pattern exploit"; pcre:"/VIEW.*: 9[0-9]/i"; sid:9009;)'),
]
HEADER_LINES = [
    ("custom", 'alert tcp 10.0.0.0/29 any -> any [22,443] (msg:"one net"; sid:9101;)'),
    ("custom", 'alert tcp !10.0.0.0/28 any <> 10.0.0.4 1024:1027 (msg:"both ways"; sid:9102;)'),
    ("custom", 'alert any any 1024: -> 10.0.1.2 !22 (msg:"high ports"; sid:9103;)'),
]
WEB_LINES = [
    ("webattack", 'alert tcp any any -> any 80 (msg:"XSS script"; content:"<SCRIPT"; content:"track("; nocase; sid:9201;)'),
    ("webattack", 'alert tcp any any -> any 80 (msg:"SQLi words"; content:"the"; content:"and"; sid:9202;)'),
    ("webattack", 'alert tcp any any -> any 80 (msg:"anchor"; content:"#top"; sid:9203;)'),
]


def rule_table(spark: SparkSession, lines=RULE_LINES) -> DataFrame:
    rows = [(i, c, t) for i, (c, t) in enumerate(lines)]
    text = spark.createDataFrame(rows, "rule_order long, category string, raw string")
    return rules.parse_rules(text, "category")


HITS_SQL = f"""{ad.cte("packets")}, hits AS (
SELECT *, 0 AS rule_order, '9001' AS rule_id FROM packets WHERE protocol = 'TCP' AND dst_port = 80 AND contains(payload, 'error')
UNION ALL SELECT *, 1, '9002' FROM packets WHERE protocol = 'TCP' AND flag_bits = 2
UNION ALL SELECT *, 2, '9003' FROM packets WHERE dst_port = 22 AND contains(lower(payload), 'click')
UNION ALL SELECT *, 3, '9004' FROM packets WHERE protocol = 'UDP'
UNION ALL SELECT *, 4, '9005' FROM packets WHERE protocol = 'ICMP' AND icmp_type = 8
UNION ALL SELECT *, 5, '9006' FROM packets WHERE protocol = 'TCP' AND dst_port = 3306 AND contains(payload, 'purchase') AND contains(payload, '7')
UNION ALL SELECT *, 6, '9009' FROM packets WHERE protocol = 'TCP' AND regexp_matches(payload, 'VIEW.*: 9[0-9]', 'i'))"""

RULE_DIM = """dim(rule_order, rule_id, name, severity, kind) AS (VALUES
 (0, '9001', 'DoS error flood', 'CRITICAL', 'DoS'), (1, '9002', 'Port Scan SYN Sweep', 'HIGH', 'PortScan'),
 (2, '9003', 'SSH Login Attempt', 'MEDIUM', 'BruteForce'), (3, '9004', 'UDP info', 'LOW', 'DoS'),
 (4, '9005', 'ICMP probe', 'MEDIUM', 'PortScan'), (5, '9006', 'policy purchase', 'LOW', 'WebAttack'),
 (6, '9009', 'pattern exploit', 'CRITICAL', 'custom'))"""


@register("sig_match_all", f"WITH {HITS_SQL} SELECT packet_id, rule_order, rule_id FROM hits")
def match_all(spark, sf):
    return rules.all_matches(packets(spark, sf), rule_table(spark)).select("packet_id", "rule_order", "rule_id")


@register(
    "sig_first_match",
    f"""WITH {HITS_SQL}, {RULE_DIM}, first AS (SELECT packet_id, min(rule_order) AS rule_order FROM hits GROUP BY 1)
SELECT p.packet_id, f.rule_order IS NOT NULL AS matched, d.rule_id, d.severity AS rule_severity,
 coalesce(d.kind, 'BENIGN') AS sig_type, CASE WHEN f.rule_order IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS sig_confidence,
 'Signature match: ' || d.name || ' [' || d.rule_id || '] — ' || d.kind AS sig_description
FROM packets p LEFT JOIN first f USING (packet_id) LEFT JOIN dim d ON d.rule_order = f.rule_order""",
)
def first_match(spark, sf):
    return rules.first_match(packets(spark, sf), rule_table(spark)).select(
        "packet_id", "matched", "rule_id", "rule_severity", "sig_type", "sig_confidence", "sig_description"
    )


@register(
    "sig_hits_per_rule",
    f"""WITH {HITS_SQL}, {RULE_DIM} SELECT d.rule_id, d.name, d.severity, TRUE AS enabled, count(h.packet_id) AS hits
FROM dim d LEFT JOIN hits h ON h.rule_order = d.rule_order GROUP BY ALL""",
)
def hits_per_rule(spark, sf):
    t = rule_table(spark)
    return rules.hits_per_rule(rules.all_matches(packets(spark, sf), t), t)


@register(
    "sig_rule_totals",
    f"WITH {HITS_SQL} SELECT count(*) AS total_hits, 7 AS enabled_rules, 3 AS severe_rules FROM hits",
)
def rule_totals(spark, sf):
    return rules.rule_totals(hits_per_rule(spark, sf))


@register(
    "sig_header_match",
    f"""WITH {ad.cte("packets")}, n AS (SELECT *, split_part(src_ip, '.', 3)::INT AS s3, split_part(src_ip, '.', 4)::INT AS s4,
 split_part(dst_ip, '.', 3)::INT AS d3, split_part(dst_ip, '.', 4)::INT AS d4 FROM packets)
SELECT packet_id, '9101' AS rule_id FROM n WHERE protocol = 'TCP' AND s3 = 0 AND s4 < 8 AND dst_port IN (22, 443)
UNION ALL SELECT packet_id, '9102' FROM n WHERE protocol = 'TCP' AND (
 (NOT (s3 = 0 AND s4 < 16) AND dst_ip = '10.0.0.4' AND dst_port BETWEEN 1024 AND 1027)
 OR (NOT (d3 = 0 AND d4 < 16) AND src_ip = '10.0.0.4' AND src_port BETWEEN 1024 AND 1027))
UNION ALL SELECT packet_id, '9103' FROM n WHERE src_port >= 1024 AND dst_ip = '10.0.1.2' AND dst_port <> 22""",
)
def header_match(spark, sf):
    t = rule_table(spark, HEADER_LINES)
    return rules.all_matches(packets(spark, sf), t, headers=True).select("packet_id", "rule_id")


@register(
    "sig_payload_match",
    """WITH p AS (SELECT 'p' || page_id AS id, html AS t FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents)
SELECT id, '9201' AS rule_id FROM p WHERE contains(lower(t), '<script') AND contains(lower(t), 'track(')
UNION ALL SELECT id, '9202' FROM p WHERE contains(t, 'the') AND contains(t, 'and')
UNION ALL SELECT id, '9203' FROM p WHERE contains(t, '#top')""",
)
def payload_match(spark, sf):
    """Content patterns against whole page and document bodies as raw bytes."""
    pages = ad.table(spark, sf, "pages").selectExpr("concat('p', page_id) AS id", "encode(html, 'UTF-8') AS payload")
    docs = ad.table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "encode(text, 'UTF-8') AS payload")
    body = pages.unionByName(docs).selectExpr(
        "id", "payload", "'TCP' AS protocol", "80 AS dst_port", "0 AS flag_bits"
    )
    return rules.all_matches(body, rule_table(spark, WEB_LINES)).select("id", "rule_id")


@register(
    "sig_rate_threshold",
    f"""WITH RECURSIVE {HITS_SQL}, spec(rule_id, kind, track, need, span) AS (VALUES ('9002', 'both', 'src', 3, 86400000000::BIGINT),
 ('9003', 'threshold', 'dst', 4, 172800000000::BIGINT), ('9004', 'limit', 'src', 2, 86400000000::BIGINT)),
m AS (SELECT h.rule_id, CASE track WHEN 'src' THEN src_ip ELSE dst_ip END AS tracked, kind, need, span, t_us, packet_id FROM hits h JOIN spec USING (rule_id)),
c AS (SELECT *, count(*) OVER (PARTITION BY rule_id, tracked ORDER BY t_us RANGE BETWEEN span PRECEDING AND CURRENT ROW) AS n FROM m),
reached AS (SELECT rule_id, tracked, kind, span, t_us, min(packet_id) AS packet_id FROM c WHERE n >= need AND kind <> 'limit' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, tracked ORDER BY t_us) AS rn FROM reached WHERE kind = 'both'),
f AS (SELECT rule_id, tracked, rn, t_us, span, t_us AS anchor, packet_id FROM o WHERE rn = 1 UNION ALL
 SELECT o.rule_id, o.tracked, o.rn, o.t_us, o.span, CASE WHEN o.t_us > f.anchor + o.span THEN o.t_us ELSE f.anchor END, o.packet_id
 FROM f JOIN o ON o.rule_id = f.rule_id AND o.tracked = f.tracked AND o.rn = f.rn + 1),
lo AS (SELECT *, row_number() OVER (PARTITION BY rule_id, tracked ORDER BY t_us, packet_id) AS rn FROM m WHERE kind = 'limit'),
lf AS (SELECT rule_id, tracked, rn, t_us, span, t_us AS anchor, packet_id, need FROM lo WHERE rn = 1 UNION ALL
 SELECT lo.rule_id, lo.tracked, lo.rn, lo.t_us, lo.span, CASE WHEN lo.t_us > lf.anchor + lo.span THEN lo.t_us ELSE lf.anchor END, lo.packet_id, lo.need
 FROM lf JOIN lo ON lo.rule_id = lf.rule_id AND lo.tracked = lf.tracked AND lo.rn = lf.rn + 1),
lr AS (SELECT *, row_number() OVER (PARTITION BY rule_id, tracked, anchor ORDER BY rn) AS k FROM lf)
SELECT rule_id, tracked, 'both' AS threshold_type, t_us, packet_id FROM f WHERE anchor = t_us
UNION ALL SELECT rule_id, tracked, kind, t_us, packet_id FROM reached WHERE kind = 'threshold'
UNION ALL SELECT rule_id, tracked, 'limit', t_us, packet_id FROM lr WHERE k <= need""",
)
def rate_threshold(spark, sf):
    t = rule_table(spark)
    return rules.rate_alerts(rules.all_matches(packets(spark, sf), t), t)


PART_RULE = (
    "concat('alert tcp any any -> 10.0.0.0/8 ', CAST(p_size AS STRING), ' (msg:\"', p_name, ' (x)\"; content:\"', p_brand, "
    "'\"; content:\"; ', p_type, '\"; ', CASE WHEN p_partkey % 2 = 0 THEN 'nocase; ' ELSE '' END, "
    "CASE WHEN p_partkey % 3 = 0 THEN concat('threshold: type both, track by_src, count ', CAST(p_size AS STRING), "
    "', seconds 60; ') ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('sid:', CASE WHEN p_partkey % 17 = 0 THEN 'A' ELSE '' END, "
    "CAST(p_partkey AS STRING), '; ') END, "
    "'flags:', CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE 'SA' END, '; priority:', CAST(p_size % 6 AS STRING), "
    "';', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ')' END)"
)


PART_LINE = f"CASE WHEN p_partkey % 11 = 0 THEN '# note' WHEN p_partkey % 13 = 0 THEN 'not a rule' ELSE {PART_RULE} END"


def part_rule_lines(spark, sf):
    part = ad.table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("rule_order"), F.expr(PART_LINE).alias("raw"))


PARSED_SQL = """parsed AS (SELECT p_partkey AS rule_order, CASE WHEN p_partkey % 17 = 0 THEN 'A' ELSE '' END || p_partkey AS rule_id, p_name || ' (x)' AS name, 'alert' AS action, 'tcp' AS protocol,
 '10.0.0.0/8' AS dst_ip, p_size::VARCHAR AS dst_port, p_brand || '|; ' || p_type AS patterns, p_partkey % 2 = 0 AS nocase,
 CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE 'SA' END AS flags, CASE WHEN p_partkey % 3 = 0 THEN 'both' END AS threshold_type,
 CASE WHEN p_partkey % 3 = 0 THEN 'by_src' END AS threshold_track, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS threshold_count,
 CASE WHEN p_partkey % 3 = 0 THEN 60 END AS threshold_seconds, p_size % 6 AS priority, 1 AS rev,
 CASE p_size % 6 WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 4 THEN 'Low' ELSE 'Medium' END AS class_severity
 FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 5 <> 0)"""
PARSED_COLS = (
    "rule_order, rule_id, name, action, protocol, dst_ip, dst_port, patterns, nocase, flags, threshold_type, "
    "threshold_track, threshold_count, threshold_seconds, priority, rev, class_severity"
)


def _parsed(df):
    return df.withColumn("patterns", F.array_join("content_patterns", "|")).select(
        *[c.strip() for c in PARSED_COLS.split(",")]
    )


@register("sig_parse_rules", f"WITH {PARSED_SQL} SELECT {PARSED_COLS} FROM parsed")
def parse_rules(spark, sf):
    return _parsed(rules.parse_rules(part_rule_lines(spark, sf)))


@register("sig_rule_records", f"WITH {PARSED_SQL} SELECT {PARSED_COLS} FROM parsed WHERE rule_order % 17 <> 0 AND rule_order % 7 <> 0")
def rule_records(spark, sf):
    return _parsed(rules.rule_records(part_rule_lines(spark, sf)))


PROTOS, PORTS = ["tcp", "udp", "any", "icmp", "sctp"], [22, 80, 443, 3306]


@register(
    "sig_match_part_rules",
    f"""WITH {ad.cte("packets")}, p AS (SELECT * REPLACE (CASE WHEN packet_id % 17 = 0 THEN 'SCTP' ELSE protocol END AS protocol) FROM packets),
r AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * 1000003 END AS rule_order, p_partkey, {PROTOS}[p_partkey % 5 + 1] AS proto,
 {PORTS}[p_partkey % 4 + 1] AS port, ': ' || p_partkey % 97 || '}}' AS word FROM part)
SELECT packet_id, rule_order, p_partkey::VARCHAR AS rule_id FROM p JOIN r ON (proto = 'any' OR upper(proto) = protocol) AND dst_port = port AND contains(payload, word)
UNION ALL SELECT packet_id, rule_order, (1000000 + p_partkey)::VARCHAR FROM p JOIN r ON (proto = 'any' OR upper(proto) = protocol) AND contains(payload, word) AND flag_bits = 2 AND protocol = 'TCP'""",
)
def match_part_rules(spark, sf):
    """Two rules per part, with sparse and missing orders, over six protocols."""
    return rules.all_matches(*part_rules(spark, sf)).select("packet_id", "rule_order", "rule_id")


@register("sig_pattern_index", ORACLES["sig_match_part_rules"])
def pattern_index(spark, sf):
    """The same rules, found by one automaton over all their patterns."""
    return rules.content_matches(*part_rules(spark, sf)).select("packet_id", "rule_order", "rule_id")


def part_rules(spark, sf):
    """Packets over six protocols, and the rules made of parts."""
    key = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    head = F.concat(F.lit("alert "), pick(PROTOS), F.lit(" any any -> any "))
    content = F.concat(F.lit('content:": '), (key % 97).cast("string"), F.lit('}"; sid:'))
    first = F.concat(head, pick(PORTS).cast("string"), F.lit(' (msg:"a"; '), content, key.cast("string"), F.lit(";)"))
    second = F.concat(head, F.lit('any (msg:"b"; flags:S; '), content, (key + 1_000_000).cast("string"), F.lit(";)"))
    lines = ad.table(spark, sf, "part").select(
        F.when(key % 10 != 0, key * 1_000_003).alias("rule_order"), F.explode(F.array(first, second)).alias("raw")
    )
    seen = packets(spark, sf).withColumn("protocol", F.when(F.col("packet_id") % 17 == 0, "SCTP").otherwise(F.col("protocol")))
    return seen, rules.parse_rules(lines)


_TYPES = [*rules.CLASSTYPE_SEVERITY, "unlisted"]


@register(
    "sig_class_severity",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN p_partkey % 13 = {i} THEN '{s}'" for i, s in enumerate(rules.CLASSTYPE_SEVERITY.values()))
    + " ELSE CASE p_size % 6 WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 4 THEN 'Low' ELSE 'Medium' END END AS severity FROM part",
)
def class_severity(spark, sf):
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    kind = F.element_at(kinds, (F.col("p_partkey") % 13 + 1).cast("int"))
    return ad.table(spark, sf, "part").select(
        "p_partkey", rules.class_severity(kind, (F.col("p_size") % 6).cast("int")).alias("severity")
    )


@register(
    "sig_name_severity",
    """WITH n AS (SELECT p_partkey, lower(p_name || ' ' || ['Flood test', 'info only', 'XSS try', 'Probe', 'yellow', 'plain', 'Violation'][p_partkey % 7 + 1]) AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, 'flood|ddos|exploit|shellcode|overflow|critical') THEN 'CRITICAL'
 WHEN regexp_matches(t, 'brute|force|injection|sqli|xss|scan|high') THEN 'HIGH' WHEN regexp_matches(t, 'probe|scan|attempt|medium') THEN 'MEDIUM'
 WHEN regexp_matches(t, 'info|low|policy|violation') THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM n""",
)
def name_severity(spark, sf):
    words = F.array(*[F.lit(x) for x in ["Flood test", "info only", "XSS try", "Probe", "yellow", "plain", "Violation"]])
    name = F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 7 + 1).cast("int")))
    return ad.table(spark, sf, "part").select("p_partkey", rules.name_severity(name).alias("severity"))


_CATS = [*rules.CATEGORY_CLASS, "Other Thing"]


@register(
    "sig_attack_class",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN p_partkey % 15 = {i} THEN '{s}'" for i, s in enumerate(rules.CATEGORY_CLASS.values()))
    + " ELSE ' OTHER THING ' END AS kind FROM part",
)
def attack_class(spark, sf):
    cats = F.array(*[F.lit(f" {c.upper()} ") for c in _CATS])
    return ad.table(spark, sf, "part").select(
        "p_partkey", rules.attack_class(F.element_at(cats, (F.col("p_partkey") % 15 + 1).cast("int"))).alias("kind")
    )


REGISTRY_SQL = f"""{ad.cte("rule_changes")}, ev AS (SELECT c.*, ts FROM rule_changes c JOIN events ON event_id = change_id),
b AS (SELECT rule_id, max(CASE WHEN op = 'create' THEN change_id END) AS born, max(CASE WHEN op = 'delete' THEN change_id END) AS gone FROM ev GROUP BY 1),
live AS (SELECT * FROM b WHERE born IS NOT NULL AND (gone IS NULL OR gone < born)),
mine AS (SELECT ev.* FROM ev JOIN live USING (rule_id) WHERE change_id >= born),
registry AS (SELECT rule_id, last(rule_name ORDER BY change_id) FILTER (rule_name IS NOT NULL) AS rule_name,
 last(attack_category ORDER BY change_id) FILTER (attack_category IS NOT NULL) AS attack_category,
 upper(last(severity ORDER BY change_id) FILTER (severity IS NOT NULL)) AS severity,
 last(enabled ORDER BY change_id) FILTER (enabled IS NOT NULL) AS enabled, count(*) AS version FROM mine GROUP BY rule_id)"""


def registry(spark, sf):
    return rules.current_rules(ad.load(spark, sf, "rule_changes"))


@register("sig_registry", f"WITH {REGISTRY_SQL} SELECT * FROM registry")
def current(spark, sf):
    return registry(spark, sf)


FIRED = "concat('S', CAST((event_id * 31) % 101 AS STRING))"


@register(
    "sig_rule_as_of",
    f"""WITH {ad.cte("alerts")}, {ad.cte("rule_changes")}, c AS (SELECT c.*, epoch_us(ts) AS t_us FROM rule_changes c JOIN events ON event_id = change_id),
n AS (SELECT *, row_number() OVER w AS pos, max(CASE WHEN op IN ('create', 'delete') THEN struct_pack(t := t_us, i := change_id) END) OVER w AS mark FROM c WINDOW w AS (PARTITION BY rule_id ORDER BY t_us, change_id)),
v AS (SELECT n.*, m.op = 'create' AS live, CASE WHEN m.op = 'create' THEN n.pos - m.pos + 1 END AS version FROM n LEFT JOIN n m ON m.rule_id = n.rule_id AND m.change_id = n.mark.i),
last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY rule_id, t_us ORDER BY change_id DESC) = 1),
a AS (SELECT alert_id, t_us, {FIRED} AS rule_id FROM alerts)
SELECT a.alert_id, a.rule_id, change_id, op, version, CASE WHEN change_id IS NOT NULL THEN coalesce(live, false) END AS live
FROM a ASOF LEFT JOIN last ON a.rule_id = last.rule_id AND a.t_us >= last.t_us""",
)
def rule_as_of(spark, sf):
    alerts = ad.load(spark, sf, "alerts").select("alert_id", "t_us", F.expr(FIRED).alias("rule_id"))
    times = ad.table(spark, sf, "events").selectExpr("event_id AS change_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS t_us")
    changes = ad.load(spark, sf, "rule_changes").join(times, "change_id")
    return rules.rules_as_of(alerts, changes).select("alert_id", "rule_id", "change_id", "op", "version", "live")


@register(
    "sig_registry_list",
    f"""WITH {REGISTRY_SQL} SELECT rule_id, attack_category, count(*) OVER () AS total FROM registry WHERE enabled""",
)
def registry_list(spark, sf):
    listed = rules.list_rules(registry(spark, sf), enabled=True).select("rule_id", "attack_category")
    total = listed.agg(F.count(F.lit(1)).alias("total"))
    return listed.crossJoin(F.broadcast(total))


@register("sig_registry_search", f"WITH {REGISTRY_SQL} SELECT rule_id, rule_name FROM registry WHERE contains(lower(rule_name), 'k\": 1') OR contains(lower(rule_id), 's2')")
def registry_search(spark, sf):
    hit = rules.search_rules(registry(spark, sf), "S2").unionByName(rules.search_rules(registry(spark, sf), 'K": 1'))
    return hit.select("rule_id", "rule_name").distinct()


@register("sig_next_rule_id", f"WITH {REGISTRY_SQL} SELECT greatest(max(replace(rule_id, 'S', '')::BIGINT), 1012) + 1 AS next_id FROM registry")
def next_rule_id(spark, sf):
    return rules.next_rule_id(registry(spark, sf))
