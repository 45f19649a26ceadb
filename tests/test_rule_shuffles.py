import re

import pytest

from tests.test_rules import PACKETS, pkt
from tidewatch.operators import rules


def table(spark, lines):
    return rules.parse_rules(spark.createDataFrame(list(enumerate(lines)), "rule_order long, raw string"))


def lines(words, plain=False):
    """A word, a port and a protocol; rules 0 and 200, 1 and 201 ... are one condition."""
    text = lambda i: "" if plain and i % 10 == 0 else f'content:"w{i % words};"; '
    return [f'alert {("tcp", "any")[i % 2]} any any -> any {(80, "any", 443, 22)[i % 4]} (msg:"m"; {text(i)}sid:{i};)' for i in range(400)]


def seen(spark):
    return spark.createDataFrame([pkt(i, ("TCP", "UDP", "GRE")[i % 3], (80, 443, None)[i % 3 if i % 2 else 0], payload=b"w%d; w%d;" % (i, i + 1)) for i in range(100)], PACKETS)


def wanted(words, plain=False):
    out = []
    for i in range(100):
        proto, port = ("TCP", "UDP", "GRE")[i % 3], (80, 443, None)[i % 3 if i % 2 else 0]
        for k in range(400):
            text = (plain and k % 10 == 0) or k % words in (i, i + 1)
            if text and (k % 2 or proto == "TCP") and (80, port, 443, 22)[k % 4] == port:
                out.append((i, str(k)))
    return sorted(out)


def found(df):
    return sorted((r["packet_id"], r["rule_id"]) for r in df.select("packet_id", "rule_id").collect())


@pytest.fixture
def no_small_tables(spark):
    """Only what is asked to be broadcast is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(df) -> list[str]:
    """Plans of what is dealt out by a key."""
    return re.findall(r"Exchange hashpartitioning\((\w+?)#", df._jdf.queryExecution().executedPlan().toString())


def check_shuffles(spark, matches):
    """Whole packets are not dealt out to find their conditions, only what is asked of them is, to find the rules."""
    df = matches(seen(spark), table(spark, lines(100))).select("packet_id", "rule_id")
    assert shuffled(df) == ["__cond", "__cond"]
    assert found(df) == wanted(100) and len(wanted(100)) > 100


def test_all_matches_shuffles_no_packets(spark, no_small_tables):
    check_shuffles(spark, rules.all_matches)


def test_all_matches_sorts_no_rules(spark, monkeypatch):
    """Rules that are one condition are told apart by hashing."""
    plans = {}

    def kept(df, name, codec=None, cut=rules.cut_lineage):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name, codec)

    monkeypatch.setattr(rules, "cut_lineage", kept)
    assert found(rules.all_matches(seen(spark), table(spark, lines(100)))) == wanted(100)
    assert plans and not any("SortAggregate" in p for p in plans.values())


@pytest.mark.parametrize("words", [5, 100])
def test_rules_with_and_without_text(spark, no_small_tables, words):
    for matches in (rules.all_matches, rules.content_matches):
        assert found(matches(seen(spark), table(spark, lines(words, True)))) == wanted(words, True)


def test_content_matches_shuffles_no_packets(spark, no_small_tables):
    check_shuffles(spark, rules.content_matches)


@pytest.mark.parametrize("shard_bytes", [1, 500, 16 << 20])
def test_shards_of_conditions(spark, monkeypatch, shard_bytes):
    """A set of patterns whose conditions stand in several shards gives each of them once."""
    made = []
    monkeypatch.setattr(rules, "_shards", lambda *a, f=rules._shards: made.append(f(*a)) or made[-1])
    t = table(spark, lines(2)[:24])
    assert found(rules.content_matches(seen(spark), t, False, shard_bytes)) == [x for x in wanted(2) if int(x[1]) < 24]
    held = [{(r["__set"], r["__cond"].hex()) for r in shard.collect()} for shard in made[0]]
    assert sum(map(len, held)) == len(set().union(*held)) == 4 and (len(held) > 1) == (shard_bytes <= 500)
