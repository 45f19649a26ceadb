"""Signature rules: parsing, matching, rate thresholds, registry."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import network
from tidewatch.operators import anchored, ordered, skew
from tidewatch.session import cut_lineage

#: The fields before a rule's options, in order. Their names, and the two directions, are the syntax.
FIELDS = ("action", "protocol", "src_ip", "src_port", "direction", "dst_ip", "dst_port")
DIRECTIONS = ("->", "<>")
WORD = r"^\w+$"
#: An option runs to the next semicolon outside quotes.
OPTION = r'((?:[^";]++|"[^"]*+")++)'
LAST_ORDER = (1 << 63) - 1

# Class type and priority to severity.
CLASSTYPE_SEVERITY = {
    "attempted-admin": "Critical",
    "successful-admin": "Critical",
    "attempted-dos": "High",
    "successful-dos": "High",
    "denial-of-service": "High",
    "network-scan": "Medium",
    "attempted-recon": "Medium",
    "web-application-attack": "High",
    "sql-injection": "High",
    "trojan-activity": "Critical",
    "policy-violation": "Low",
    "protocol-command-decode": "Low",
}
PRIORITY_SEVERITY = {1: "Critical", 2: "High", 3: "Medium", 4: "Low"}
# Words in a rule name that hint at its severity, first level wins.
NAME_HINTS = {
    "CRITICAL": ["flood", "ddos", "exploit", "shellcode", "overflow", "critical"],
    "HIGH": ["brute", "force", "injection", "sqli", "xss", "scan", "high"],
    "MEDIUM": ["probe", "scan", "attempt", "medium"],
    "LOW": ["info", "low", "policy", "violation"],
}
# Rule category to attack class.
CATEGORY_CLASS = {
    "dos": "DoS",
    "dos flood": "DoS",
    "ddos": "DDoS",
    "portscan": "PortScan",
    "port scan": "PortScan",
    "scan": "PortScan",
    "brute force": "BruteForce",
    "bruteforce": "BruteForce",
    "web attack": "WebAttack",
    "webattack": "WebAttack",
    "sqli": "WebAttack",
    "xss": "WebAttack",
    "botnet": "Botnet",
    "infiltration": "Infiltration",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def class_severity(classtype: Column, priority: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(CLASSTYPE_SEVERITY), classtype),
        F.try_element_at(literal_map(PRIORITY_SEVERITY), priority),
        F.lit("Medium"),
    )


def name_severity(name: Column) -> Column:
    text = F.lower(name)
    out = F.lit("MEDIUM")
    for level, words in reversed(NAME_HINTS.items()):
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(hit, level).otherwise(out)
    return out


def attack_class(category: Column) -> Column:
    known = F.try_element_at(literal_map(CATEGORY_CLASS), F.lower(F.trim(category)))
    return F.coalesce(known, category)


# --- parsing ---------------------------------------------------------------


def _head(raw: Column) -> Column:
    """What stands before the options, cut at white space."""
    return F.filter(F.split(F.substring_index(raw, "(", 1), r"\s+"), lambda x: x != "")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _well_formed(head: Column) -> Column:
    """Of a head: as many fields as there should be, words and a direction where they stand."""
    field = {name: F.try_element_at(head, F.lit(k + 1)) for k, name in enumerate(FIELDS)}
    words = field["action"].rlike(WORD) & field["protocol"].rlike(WORD)
    return (F.size(head) == len(FIELDS)) & words & field["direction"].isin(*DIRECTIONS)


def _body(raw: Column) -> Column:
    """From the first bracket on."""
    return F.substring(raw, F.instr(raw, "(") + 1, F.length(raw))


def _options(body: Column) -> Column:
    """Option text to an array of (key, value); an option without a colon has an empty value."""
    def option(x):
        colon = F.instr(x, ":")
        value = F.trim(F.substring(x, colon + 1, F.length(x)))
        key = F.when(colon > 0, F.substring(x, F.lit(1), colon - 1)).otherwise(x)
        return F.struct(
            F.lower(F.trim(key)).alias("key"),
            F.when(colon > 0, F.btrim(value, F.lit('"'))).otherwise("").alias("value"),
            ((colon == 0) | (value != "")).alias("whole"),
        )

    found = F.transform(F.regexp_extract_all(body, F.lit(OPTION), F.lit(1)), option)
    return F.filter(found, lambda o: o["whole"] & o["key"].rlike(WORD))


def _threshold(text: Column) -> Column:
    """`type T, track by_X, count N, seconds S` to a map, or NULL unless all four are there."""
    pairs = F.transform(F.split(text, ","), lambda x: F.split(F.trim(x), r"\s+"))
    names = ("type", "track", "count", "seconds")

    def first(pairs: Column) -> Column:
        of = lambda name: F.try_element_at(F.transform(F.filter(pairs, lambda x: x[0] == name), lambda x: x[1]), F.lit(1))
        return F.struct(*[of(n).alias(n) for n in names])

    def checked(t: Column) -> Column:
        whole = t["type"].isNotNull() & t["track"].startswith("by_") & t["count"].rlike(r"^\d+$") & t["seconds"].rlike(r"^\d+$")
        return F.when(whole, t)

    return _once(_once(F.filter(pairs, lambda x: F.size(x) == 2), first), checked)


def _values(opts: Column, key: str) -> Column:
    return F.transform(F.filter(opts, lambda o: o["key"] == key), lambda o: o["value"])


def _value(opts: Column, key: str) -> Column:
    return F.try_element_at(_values(opts, key), F.lit(1))


#: options of which the first counts
SINGLE = ("sid", "msg", "flags", "itype", "threshold", "classtype", "priority", "rev")


def _read(opts: Column) -> Column:
    """What a rule says in its options, as one struct."""
    one = {k: _value(opts, k) for k in SINGLE}
    return F.struct(
        *[v.alias(k) for k, v in one.items() if k != "threshold"],
        _threshold(one["threshold"]).alias("threshold"),
        _values(opts, "content").alias("content"),
        _values(opts, "pcre").alias("pcre"),
        F.exists(opts, lambda o: o["key"] == "nocase").alias("nocase"),
    )


def _parsed(raw: Column) -> Column:
    """A line's head and options, or NULL if it is blank, a comment, malformed or without sid. Each part is read once."""
    text = F.trim(raw)
    body = F.rtrim(_body(raw), F.lit(") \t\r\n"))

    def whole(head: Column) -> Column:
        said = _once(_once(_options(body), _read), lambda o: F.when(F.coalesce(o["sid"], F.lit("")) != "", o))
        return F.when(_well_formed(head), F.struct(head.alias("head"), said.alias("said")))

    worth = (text != "") & ~text.startswith("#") & raw.contains("(")
    return F.when(worth, _once(_head(raw), whole))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def parse_rules(lines: DataFrame, category: str | None = None) -> DataFrame:
    """Rule lines (``raw``, optionally ``rule_order``) to rule columns.

    Blank, comment and malformed lines and rules without sid are dropped.
    ``category`` names a column with the attack category of the file.
    """
    # a file of lines is small for the work it takes, so it is dealt out first; the parsed line comes as a
    # generated row, so that it is not read again for each column and condition on it
    out = lines.repartition("raw").withColumn("rule", F.explode(F.array(_parsed(F.col("raw"))))).filter("rule.said IS NOT NULL")
    head = lambda i: F.col("rule.head")[i - 1]
    said = lambda name: F.col("rule.said")[name]
    thr = lambda name: said("threshold")[name]
    out = out.select(
        *[c for c in lines.columns if c != "raw"],
        said("sid").alias("rule_id"),
        F.coalesce(said("msg"), F.lit("")).alias("name"),
        head(1).alias("action"),
        head(2).alias("protocol"),
        head(3).alias("src_ip"),
        head(4).alias("src_port"),
        head(5).alias("direction"),
        head(6).alias("dst_ip"),
        head(7).alias("dst_port"),
        said("content").alias("content_patterns"),
        said("pcre").alias("pcre"),
        said("nocase").alias("nocase"),
        said("flags").alias("flags"),
        _int(F.coalesce(said("itype"), F.lit(""))).alias("itype"),
        thr("type").alias("threshold_type"),
        thr("track").alias("threshold_track"),
        _int(thr("count")).alias("threshold_count"),
        _int(thr("seconds")).alias("threshold_seconds"),
        said("classtype").alias("classtype"),
        F.coalesce(_int(F.coalesce(said("priority"), F.lit(""))), F.lit(3)).alias("priority"),
        F.coalesce(_int(F.coalesce(said("rev"), F.lit(""))), F.lit(1)).alias("rev"),
        F.lit(True).alias("enabled"),
        "raw",
    )
    return out.withColumn("class_severity", class_severity(F.col("classtype"), F.col("priority"))).withColumn(
        "severity", name_severity(F.col("name"))
    ).withColumn("attack_category", F.col(category) if category else F.lit("generic"))


def rule_records(lines: DataFrame, category: str | None = None) -> DataFrame:
    """The stricter record form: the line ends with the options' closing bracket, brackets
    inside them close one opened since the last closing one, msg and a numeric sid are there."""
    def closed(pieces: Column) -> Column:
        return F.forall(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: x.contains("("))

    def whole(text: Column) -> Column:
        inner = F.substring(_body(text), F.lit(1), F.length(_body(text)) - 1)
        return text.endswith(")") & _once(inner, lambda x: (x != "") & _once(F.split(x, r"\)"), closed))

    good = lines.filter(_once(F.rtrim(F.col("raw"), F.lit(" \t\r\n")), whole))
    return parse_rules(good, category).filter((F.col("name") != "") & F.col("rule_id").rlike(r"^\d+"))


def numbered(rules: DataFrame) -> DataFrame:
    """Rules with ``rule_order`` 0, 1, 2 ... in their order; rules without an order come last."""
    order = [F.col("rule_order").asc_nulls_last(), F.col("rule_id")]
    placed = ordered.positions(ordered.sliced(cut_lineage(rules, "rules"), order), [], "slice", order, "__place")
    return placed.withColumn("rule_order", F.col("__place").cast("long")).select(rules.columns)


# --- matching --------------------------------------------------------------


def _flag_mask(flags: Column) -> Column:
    letters = F.upper(F.coalesce(flags, F.lit("")))
    return reduce(
        lambda a, b: a + b,
        [F.when(letters.contains(x), b).otherwise(0) for x, b in network.FLAG_LETTERS.items()],
    )


def _items(text: Column, bounds) -> Column:
    """`x`, `!x`, `[x,!y]`, `![x,y]` to the list's own negation and an array of (lo, hi, no); any -> NULL."""
    items = F.split(F.regexp_replace(text, r"^!?\[|\]$", ""), ",")

    def item(x):
        x = F.trim(x)
        lo, hi = bounds(F.ltrim(x, F.lit("!")))
        return F.struct(lo.alias("lo"), hi.alias("hi"), x.startswith("!").alias("no"))

    return F.when(F.lower(text) != "any", F.struct(text.startswith("![").alias("negated"), F.transform(items, item).alias("items")))


def _port_bounds(x: Column) -> tuple[Column, Column]:
    """``80``, ``1:1024``, ``1024:``, ``:80``."""
    edge = lambda i, d: F.coalesce(
        F.nullif(F.try_element_at(F.split(x, ":"), F.lit(i)), F.lit("")).try_cast("int"), F.lit(d)
    )
    return F.when(x.contains(":"), edge(1, 0)).otherwise(edge(1, -1)), F.when(x.contains(":"), edge(2, 65535)).otherwise(edge(1, -1))


def _pattern(p: Column) -> Column:
    """``/text/modifiers`` to a pattern with the modifiers i, s, m and x in front."""
    tail = F.substring_index(p, "/", -1)
    flags = F.regexp_replace(tail, "[^ismx]", "")
    text = F.when(p.startswith("/"), F.substring(p, F.lit(2), F.length(p) - F.length(tail) - 2)).otherwise(p)
    return F.concat(F.when(p.startswith("/") & (flags != ""), F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), text)


def prepare(rules: DataFrame, binary: bool) -> DataFrame:
    """Everything about a rule that does not depend on a packet, computed once."""
    pats = F.transform("content_patterns", lambda p: F.when(F.col("nocase"), F.lower(p)).otherwise(p))
    if binary:
        pats = F.transform(pats, lambda p: p.cast("binary"))
    pcre = F.transform("pcre", _pattern)
    rule = F.struct(
        F.col("rule_order").cast("long").alias("rule_order"),
        F.col("rule_id"),
        F.col("flags").isNotNull().alias("has_flags"),
        _flag_mask(F.col("flags")).alias("mask"),
        F.coalesce(F.col("flags").contains("+"), F.lit(False)).alias("at_least"),
        F.coalesce(F.col("flags").contains("!"), F.lit(False)).alias("none_of"),
        F.col("nocase"),
        pats.alias("patterns"),
        pcre.alias("pcre"),
        F.col("itype"),
        _items(F.col("src_ip"), network.cidr_bounds).alias("src_nets"),
        _items(F.col("dst_ip"), network.cidr_bounds).alias("dst_nets"),
        _items(F.col("src_port"), _port_bounds).alias("src_spans"),
        _items(F.col("dst_port"), _port_bounds).alias("dst_spans"),
        (F.col("direction") == "<>").alias("both_ways"),
    )
    return rules.filter("enabled").select(
        rule.alias("rule"),
        F.upper("protocol").alias("__proto"),
        F.col("dst_port").try_cast("int").alias("__port"),
        (F.col("direction") == "<>").alias("__two"),
    )


def _within(value: Column, spans: Column) -> Column:
    """Any of the plain items (if there are some) and none of the negated ones; then the list's own negation."""
    hit = lambda s: F.coalesce(value.between(s["lo"], s["hi"]), F.lit(False))
    plain = F.filter(spans["items"], lambda s: ~s["no"])
    inside = ((F.size(plain) == 0) | F.exists(plain, hit)) & ~F.exists(spans["items"], lambda s: s["no"] & hit(s))
    return spans.isNull() | (F.coalesce(inside, F.lit(False)) != spans["negated"])


def _header_ok(r: Column) -> Column:
    def one_way(si, sp, di, dp):
        return (
            _within(F.col(si), r["src_nets"])
            & _within(F.col(di), r["dst_nets"])
            & _within(F.col(sp), r["src_spans"])
            & _within(F.col(dp), r["dst_spans"])
        )

    return one_way("__src", "src_port", "__dst", "dst_port") | (
        r["both_ways"] & one_way("__dst", "dst_port", "__src", "src_port")
    )


def _matches(r: Column, has_icmp: bool, headers: bool, text: bool = True) -> Column:
    bits = F.col("flag_bits").bitwiseAND(63)
    exact = F.when(r["none_of"], bits.bitwiseAND(r["mask"]) == 0).when(
        r["at_least"], bits.bitwiseAND(r["mask"]) == r["mask"]
    ).otherwise(bits == r["mask"])
    flags = ~r["has_flags"] | ((F.col("protocol") == "TCP") & exact)
    hay = F.when(r["nocase"], F.col("__lower")).otherwise(F.col("payload")) if text else None
    content = F.forall(r["patterns"], lambda p: F.coalesce(F.contains(hay, p), F.lit(False))) if text else F.lit(True)
    regex = F.forall(
        r["pcre"], lambda p: F.coalesce(F.regexp_like(F.col("payload").cast("string"), p), F.lit(False))
    )
    ok = flags & content & regex
    if has_icmp:
        ok = ok & (r["itype"].isNull() | F.coalesce(F.col("icmp_type") == r["itype"], F.lit(False)))
    return ok & _header_ok(r) if headers else ok


def with_hits(packets: DataFrame, rules: DataFrame, headers: bool = False) -> DataFrame:
    """Add ``hits``: (rule_order, rule_id) of every enabled rule a packet satisfies, in order;
    rules without an order come last.

    Rules are grouped by (protocol, port) and by protocol and reach the packets as two
    equi-joins, whatever their number. A rule for any protocol is in the group of every
    protocol that rules name and in that of all others. Spark broadcasts the groups if
    their bytes allow, so packets are neither shuffled nor multiplied; beyond that it
    joins by protocol and splits the packets of a common one. ``headers`` also enforces
    source and destination addresses, ports and direction.
    """
    binary = dict(packets.dtypes).get("payload") == "binary"
    # prepared once: the protocols' names and the two lookups below all read this small table
    ready = cut_lineage(prepare(rules, binary), "rules")
    names = sorted(r[0] for r in ready.select("__proto").distinct().collect() if r[0] != "ANY")
    lower = F.lower(F.col("payload").cast("string"))
    up = F.upper("protocol")
    p = packets.withColumn("__lower", lower.cast("binary") if binary else lower)
    p = p.withColumn("__up", F.when(up.isin(names), up).otherwise("*") if names else F.lit("*"))
    if headers:
        p = p.withColumn("__src", network.ip_number(F.col("src_ip"))).withColumn(
            "__dst", network.ip_number(F.col("dst_ip"))
        )
    groups = F.when(F.col("__proto") == "ANY", F.array(*map(F.lit, [*names, "*"]))).otherwise(F.array("__proto"))
    ready = ready.withColumn("__up", F.explode(groups))
    direct = F.col("__port").isNotNull() & (~F.col("__two") if headers else F.lit(True))
    by_port = ready.filter(direct).groupBy("__up", F.col("__port").alias("dst_port")).agg(F.collect_list("rule").alias("__a"))
    by_proto = ready.filter(~direct).groupBy("__up").agg(F.collect_list("rule").alias("__b"))
    p = p.join(by_port, ["__up", "dst_port"], "left").join(by_proto, ["__up"], "left")
    has_icmp = "icmp_type" in packets.columns
    found = [
        F.transform(
            F.filter(F.col(c), lambda r: _matches(r, has_icmp, headers)),
            lambda r: F.struct(
                F.coalesce(r["rule_order"], F.lit(LAST_ORDER)).alias("place"), r["rule_order"].alias("rule_order"), r["rule_id"].alias("rule_id")
            ),
        )
        for c in ("__a", "__b")
    ]
    empty = F.array().cast("array<struct<place:bigint,rule_order:bigint,rule_id:string>>")
    hits = F.array_sort(F.concat(*[F.coalesce(f, empty) for f in found]))
    in_order = F.transform(hits, lambda h: F.struct(h["rule_order"].alias("rule_order"), h["rule_id"].alias("rule_id")))
    return p.select(*packets.columns, in_order.alias("hits"))


#: Sets of content patterns up to which each is looked for by itself.
FEW_SETS = 64


def all_matches(packets: DataFrame, rules: DataFrame, headers: bool = False) -> DataFrame:
    """One row per (packet, rule) match.

    Rules that differ in order and id only are one condition, which a packet meets once. Conditions reach the packets
    as an equi-join by protocol and port, or, where there are many sets of patterns, by what occurs in the payload
    as well (see ``content_matches``); a last equi-join gives the rules.
    """
    return _found(packets, rules, headers, FEW_SETS, SHARD_BYTES)


#: Bytes of patterns and conditions that a task holds at a time.
SHARD_BYTES = 16 << 20


def content_matches(packets: DataFrame, rules: DataFrame, headers: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``all_matches``, found by reading each payload once, whatever the number of rules.

    All distinct sets of content patterns stand in one automaton, those of ``nocase`` rules in one over the payload in
    lower case. A payload gives the sets all of whose patterns occur; with protocol and port they are the key of an
    equi-join to the conditions, so what is formed are pairs that agree in all three. Rules without patterns, if there
    are any, meet packets by protocol and port.
    Automata and their conditions go to every task in shards of at most ``shard_bytes``, one pass each: more of them take
    more passes, not more memory. Packets are not shuffled to meet conditions; what is shuffled is a row per packet and
    condition met, with the columns that are asked for, to give the rules.
    """
    return _found(packets, rules, headers, 0, shard_bytes)


def _found(packets: DataFrame, rules: DataFrame, headers: bool, few: int, shard_bytes: int) -> DataFrame:
    binary = dict(packets.dtypes).get("payload") == "binary"
    what = F.col("rule").dropFields("rule_order", "rule_id")
    direct = F.col("__port").isNotNull() & (~F.col("__two") if headers else F.lit(True))
    ready = prepare(rules, binary).select(
        F.col("rule.rule_order").alias("rule_order"), F.col("rule.rule_id").alias("rule_id"), what.alias("__what"), "__proto",
        F.when(direct, F.col("__port").cast("string")).otherwise(ANY_PORT).alias("__at"),
    )
    said = F.col("__what")
    # in hex, as bytes that are no text would all become one sign in JSON
    spelled = said.withField("patterns", F.transform(said["patterns"], F.hex)).withField("pcre", F.transform(said["pcre"], F.hex))
    ready = ready.withColumn("__set", F.when(F.size("__what.patterns") > 0, F.md5(F.to_json(F.struct(said["nocase"].alias("nocase"), spelled["patterns"].alias("patterns"))))))
    ready = cut_lineage(ready.withColumn("__cond", F.unhex(F.md5(F.to_json(F.struct(spelled.alias("what"), "__proto", "__at"))))), "rules")
    # whole rows are told apart by hashing; to take the first of each ``__cond`` would sort all rules. Conditions are stored,
    # so that they are formed once and Spark knows their size
    conds = cut_lineage(ready.select("__cond", "__what", "__proto", "__at", "__set").distinct(), "conditions")
    protos, n_sets, n_plain = conds.agg(F.collect_set("__proto"), F.count_distinct("__set"), F.count_if(F.col("__set").isNull())).first()
    names = sorted(x for x in protos if x != "ANY")
    conds = conds.withColumn("__up", F.when(F.col("__proto") == "ANY", F.array(*map(F.lit, [*names, "*"]))).otherwise(F.array("__proto")))

    lower = F.lower(F.col("payload").cast("string"))
    given = packets.select(F.struct(*packets.columns).alias("__row"), "payload", (lower.cast("binary") if binary else lower).alias("__lower"))
    parts = []
    indexed = n_sets > few
    if n_plain or not indexed:  # else there is nothing to read the packets for
        plain = (conds.filter("__set IS NULL") if indexed else conds).withColumn("__up", F.explode("__up"))
        parts.append(_met(given, plain, packets.columns, names, ["__up", "__at"], headers, True))
    if indexed:
        schema = T.StructType([given.schema["__row"], T.StructField("__set", T.StringType())])
        for shard in _shards(conds.filter("__set IS NOT NULL"), shard_bytes):
            sets = shard.select("__set", "__what.nocase", "__what.patterns").distinct().collect()
            held = given.mapInArrow(_content_search(packets.sparkSession, sets), schema)
            small = shard.withColumn("__what", F.col("__what").dropFields("patterns")).withColumn("__up", F.explode("__up"))
            parts.append(_met(held, F.broadcast(small), packets.columns, names, ["__set", "__up", "__at"], headers, False))
    met = reduce(DataFrame.unionByName, parts)
    return met.join(ready.select("__cond", "rule_order", "rule_id"), "__cond").select(*packets.columns, "rule_order", "rule_id")


#: stands for the port of a rule that names none, or several
ANY_PORT = "any"


def _met(rows: DataFrame, conds: DataFrame, columns: list[str], names: list[str], keys: list[str], headers: bool, text: bool) -> DataFrame:
    """Packets (``__row``) with the conditions they meet, out of those that agree in the keys; ``text`` also looks for the patterns."""
    p = rows.select(*[c for c in rows.columns if c != "payload"], "__row.*")
    up = F.upper("protocol")
    p = p.withColumn("__up", F.when(up.isin(names), up).otherwise("*") if names else F.lit("*"))
    p = p.withColumn("__at", F.explode(F.array_compact(F.array(F.col("dst_port").cast("int").cast("string"), F.lit(ANY_PORT)))))
    if headers:
        p = p.withColumn("__src", network.ip_number(F.col("src_ip"))).withColumn("__dst", network.ip_number(F.col("dst_ip")))
    rest = _matches(F.col("__what"), "icmp_type" in columns, headers, text)
    return p.join(conds.select(*keys, "__cond", "__what"), keys).filter(rest).select(*columns, "__cond")


def _shards(conds: DataFrame, shard_bytes: int) -> list[DataFrame]:
    """Conditions in parts that a task can hold with their patterns; the parts' numbers come from sums of sizes over conditions in order."""
    patterns = F.aggregate("__what.patterns", F.lit(0), lambda n, x: n + F.octet_length(x) + 64)
    size = patterns + F.octet_length(F.to_json("__what")) * F.size("__up")
    upto = F.sum(size).over(Window.partitionBy("slice").orderBy("__set", "__cond"))
    cut = ordered.sliced(conds, ["__set", "__cond"], rows=max(1, shard_bytes // 256)).withColumn("shard", F.floor(upto / shard_bytes))
    cut = cut_lineage(cut, "content-shards")
    shards = [tuple(r) for r in cut.select("slice", "shard").distinct().orderBy("slice", "shard").collect()]
    return [cut.filter((F.col("slice") == a) & (F.col("shard") == b)) for a, b in shards]


def _content_search(spark: SparkSession, shard: list):
    """A task's function: the given rows, once for each set of the shard all of whose patterns occur."""
    sets = [(r["__set"], bool(r["nocase"]), [bytes(x).decode("latin-1") if isinstance(x, bytes | bytearray) else x for x in r["patterns"]]) for r in shard]
    sent = spark.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {nocase: PatternIndex([(i, p) for i, n, p in sent.value if n == nocase]) for nocase in (False, True)}
        for batch in batches:
            at, found = [], []
            for column, nocase in (("payload", False), ("__lower", True)):
                if index[nocase].size:
                    for k, text in enumerate(batch.column(column).to_pylist()):
                        here = index[nocase].rules_in(text.decode("latin-1") if isinstance(text, bytes) else text) if text is not None else ()
                        at += [k] * len(here)
                        found += here
                        if len(at) >= FOUND_ROWS:
                            yield taken(batch, at, found)
                            at, found = [], []
            if at:
                yield taken(batch, at, found)

    def taken(batch: pa.RecordBatch, at: list[int], found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(at)), pa.array(found, pa.string())], ["__row", "__set"])

    return run


#: rows that a search gives out at a time
FOUND_ROWS = 10_000


class PatternIndex:
    """Many patterns in one automaton; a rule, or set of patterns, hangs on its longest pattern and is looked at only where that occurs."""

    def __init__(self, rules: list[tuple[int, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        numbers: dict[str, int] = {}
        self.needs = [{numbers.setdefault(p, len(numbers)) for p in patterns if p} for _, patterns in rules]
        self.ids = [i for i, _ in rules]
        self.by_pattern: dict[int, list[int]] = {}
        self.always = []
        names = list(numbers)
        for k, need in enumerate(self.needs):
            if need:
                self.by_pattern.setdefault(max(need, key=lambda x: len(names[x])), []).append(k)
            else:
                self.always.append(k)  # only empty patterns, which any payload holds
        for name, number in numbers.items():
            self.automaton.add_word(name, number)
        if numbers:
            self.automaton.make_automaton()
        self.size = len(rules)

    def rules_in(self, text: str) -> list[int]:
        seen = {n for _, n in self.automaton.iter(text)} if len(self.automaton) else set()
        hit = [k for n in seen for k in self.by_pattern.get(n, ()) if self.needs[k] <= seen]
        return [self.ids[k] for k in self.always + hit]


def rule_versions(changes: DataFrame) -> DataFrame:
    """Each change with the version it makes: the number of changes since the rule's latest create, null where there
    was none yet, and ``live``: false from a delete on until the next create."""
    keys, order = ["rule_id"], ["t_us", "change_id"]
    placed = ordered.positions(ordered.sliced(cut_lineage(changes, "changes"), [*keys, *order]), keys, "slice", order).drop("slice")
    begun = F.when(F.col("op") == "create", F.struct(F.col("pos").alias("born"), F.lit(True).alias("live")))
    ended = F.when(F.col("op") == "delete", F.struct(F.lit(None).cast("long").alias("born"), F.lit(False).alias("live")))
    known = ordered.carried(placed.withColumn("state", F.coalesce(begun, ended)), keys, order, "state")
    version = F.when(F.col("state.live"), F.col("pos") - F.col("state.born") + 1)
    return known.select(*changes.columns, version.alias("version"), F.coalesce("state.live", F.lit(False)).alias("live"))


def rules_as_of(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Each alert (rule_id, t_us, ...) with the change that was in force when it was raised: change_id, op, version, live."""
    return ordered.as_of(alerts, rule_versions(changes), ["rule_id"], "t_us", ["change_id", "op", "version", "live"], "change_id")


def first_match(rows: DataFrame, rules: DataFrame, headers: bool = False) -> DataFrame:
    """The first matching rule of every row in rule order; rows without one stay."""
    rules = numbered(rules)
    hit = with_hits(rows, rules, headers).withColumn(
        "rule_order", F.try_element_at("hits", F.lit(1))["rule_order"]
    )
    return describe_match(hit.drop("hits"), rules)


def describe_match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Signature result columns for a row that carries ``rule_order`` (or NULL)."""
    kind = attack_class(F.col("attack_category"))
    names = rules.select(
        F.col("rule_order").cast("long").alias("rule_order"),
        F.col("rule_id").alias("rule_id"),
        F.col("severity").alias("rule_severity"),
        kind.alias("sig_type"),
        F.format_string("Signature match: %s [%s] — %s", "name", "rule_id", kind).alias("sig_description"),
    )
    matched = F.col("rule_order").isNotNull()
    return rows.join(names, "rule_order", "left").withColumns(
        {
            "matched": matched,
            "sig_type": F.coalesce("sig_type", F.lit("BENIGN")),
            "sig_confidence": F.when(matched, 1.0).otherwise(0.0),
        }
    )


def hits_per_rule(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Match count for every rule, zero included."""
    n = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rules.select("rule_id", "name", "severity", "enabled").join(n, "rule_id", "left").select(
        "rule_id", "name", "severity", "enabled", F.coalesce("n", F.lit(0)).alias("hits")
    )


def rule_totals(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.sum("hits").alias("total_hits"),
        F.count_if("enabled").alias("enabled_rules"),
        F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("severe_rules"),
    )


# --- rate thresholds -------------------------------------------------------


def thresholds(rules: DataFrame) -> DataFrame:
    """Kind, tracked side, count and span (microseconds) of the rules that have a rate threshold."""
    return rules.filter("threshold_type IS NOT NULL").select(
        "rule_id", "threshold_type", "threshold_track", F.col("threshold_count").cast("long").alias("need"),
        (F.col("threshold_seconds") * F.lit(1_000_000).cast("long")).alias("span"),
    )


def rate_alerts(
    matches: DataFrame, rules: DataFrame, t: str = "t_us", row_id: str = "packet_id", slice_rows: int = ordered.SLICE_ROWS
) -> DataFrame:
    """Enforce ``threshold: type, track, count N, seconds S`` on packet matches.

    A time is reached when the row N-1 places before it (per rule and tracked
    address) is at most S seconds old. ``threshold`` keeps all reached rows, ``both``
    one per S window, ``limit`` the first N rows of each S window. Places come from
    positions in slices of rows, the look-back is an equi-join on the place, so a flooding
    address is spread over many tasks.
    """
    spec = thresholds(rules)
    keys = ["rule_id", "tracked"]
    seen = matches.select("rule_id", F.col(t).alias("t"), F.col(row_id).alias("id"), "src_ip", "dst_ip")
    m = (
        seen.join(spec, "rule_id")
        .withColumn("tracked", F.when(F.col("threshold_track") == "by_dst", F.col("dst_ip")).otherwise(F.col("src_ip")))
        .drop("src_ip", "dst_ip", "threshold_track")
    )
    # matches are far fewer than packets and are read five times below
    m = ordered.sliced(cut_lineage(m, "matches"), [*keys, "t", "id"], rows=slice_rows)
    placed = cut_lineage(ordered.positions(m, keys, "slice", ["t", "id"]), "places")
    times = placed.groupBy(*keys, "t", "threshold_type", "need", "span").agg(
        F.max("pos").alias("last"), F.min("id").alias("id")
    )
    back = placed.select(*keys, F.col("pos").alias("look"), F.col("t").alias("then"))
    reached = (
        times.withColumn("look", F.col("last") - F.col("need") + 1)
        .join(back, [*keys, "look"])
        .filter(F.col("then") >= F.col("t") - F.col("span"))
    )
    once = anchored.anchored_windows(
        reached.filter("threshold_type = 'both'"), keys, "t", F.col("span"), "id"
    ).filter("opens")
    every = reached.filter("threshold_type = 'threshold'")
    windows = anchored.anchored_windows(
        placed.filter("threshold_type = 'limit'"), keys, "t", F.col("span"), "id"
    )
    base = windows.groupBy(*keys, "anchor").agg(F.min("pos").alias("base"))
    few = windows.join(base, [*keys, "anchor"]).filter("pos - base < need")
    out = [*keys, "threshold_type", F.col("t").alias("t_us"), F.col("id").alias("packet_id")]
    return once.select(out).unionByName(every.select(out)).unionByName(few.select(out))


# --- registry --------------------------------------------------------------


def current_rules(changes: DataFrame) -> DataFrame:
    """Fold a change log (create / update / toggle / delete) to the live rules.

    Only changes since the latest create count, a NULL keeps the old value, each
    change raises the version. A later delete removes the rule. Two aggregations with
    map-side combine and a salted join; no rule's log is sorted in one task.
    """
    at = F.struct("t_us", "change_id") if "t_us" in changes.columns else F.col("change_id")
    ops = changes.withColumn("at", at)
    bounds = ops.groupBy("rule_id").agg(
        F.max(F.when(F.col("op") == "create", F.col("at"))).alias("born"),
        F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("gone"),
    )
    live = bounds.filter("born IS NOT NULL AND (gone IS NULL OR gone < born)").drop("gone")
    mine = skew.salted_join(ops, live, ["rule_id"]).filter(F.col("at") >= F.col("born"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return mine.groupBy("rule_id").agg(
        newest("rule_name"),
        newest("attack_category"),
        F.upper(F.max_by("severity", F.when(F.col("severity").isNotNull(), F.col("at")))).alias("severity"),
        newest("enabled"),
        F.count(F.lit(1)).alias("version"),
    )


def list_rules(
    rules: DataFrame, category: str | None = None, severity: str | None = None, enabled: bool | None = None
) -> DataFrame:
    if category:
        rules = rules.filter(F.col("attack_category") == category)
    if severity:
        rules = rules.filter(F.col("severity") == severity.upper())
    if enabled is not None:
        rules = rules.filter(F.col("enabled") == enabled)
    return rules.orderBy("attack_category", "rule_id")


def search_rules(rules: DataFrame, text: str) -> DataFrame:
    t = text.lower()
    return rules.filter(F.lower("rule_name").contains(t) | F.lower("rule_id").contains(t))


def next_rule_id(rules: DataFrame, floor: int = 1012) -> DataFrame:
    number = F.nullif(F.regexp_replace("rule_id", "[^0-9]", ""), F.lit("")).try_cast("long")
    return rules.agg((F.greatest(F.coalesce(F.max(number), F.lit(floor)), F.lit(floor)) + 1).alias("next_id"))
