"""Stateful processors on rows that come out of order, driven by hand: no stream, but the calls that one makes."""

import random

import pandas as pd

from tidewatch.streaming import processors as pr


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Rows(Value):
    def appendList(self, rows):
        self.v = (self.v or []) + rows

    def appendValue(self, row):
        self.appendList([row])

    def put(self, rows):
        self.v = list(rows)


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Rows()

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(make, batches, delay_ms, end_ms=10**12):
    """Micro-batches of (key, row dict) through one processor for each key; rows that come out, with the batch they came in."""
    each, out, watermark, seen = {}, [], 0, 0
    for n, batch in enumerate([*batches, None]):
        if batch is None:
            watermark = end_ms
        for key in {k for k, _ in batch or []}:
            if key not in each:
                each[key] = make()
                each[key].init(Handle())
            pdf = pd.DataFrame([r for k, r in batch if k == key])
            for got in each[key].handleInputRows(key, iter([pdf]), Now(watermark)):
                out += [(n, r) for r in got.to_dict("records")]
        for key, p in each.items():
            while due := sorted(t for t in p.handle.timers if t < watermark):
                p.handle.timers.discard(due[0])
                for got in p.handleExpiredTimer(key, Now(watermark), None):
                    out += [(n, r) for r in got.to_dict("records")]
        seen = max([seen, *(r["t_us"] // 1000 for _, r in batch or [])])
        watermark = max(watermark, seen - delay_ms)
    return out, each


def dealt(rows, rng, late_ms, size=20):
    """Rows in batches, each at most `late_ms` behind its place."""
    rows = sorted(rows, key=lambda r: r[1]["t_us"] // 1000 + rng.randrange(late_ms))
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def matches(rng, kind, need, span):
    times = sorted(rng.sample(range(0, 400_000), 150))
    times += times[:40]  # several at one time
    return [(("r", "x"), {"t_us": t * 1000, "packet_id": i, "threshold_type": kind, "need": need, "span": span}) for i, t in enumerate(times)]


def plain_rates(rows, kind, need, span):
    rows = sorted((r["t_us"], r["packet_id"]) for _, r in rows)
    out, anchor, given = [], None, 0
    if kind == "limit":
        for t, i in rows:
            if anchor is None or t > anchor + span:
                anchor, given = t, 0
            given += 1
            if given <= need:
                out.append((t, i))
        return out
    for t in sorted({t for t, _ in rows}):
        inside = sum(t - span <= s <= t for s, _ in rows)
        if inside >= need and (kind == "threshold" or anchor is None or t > anchor + span):
            anchor = t
            out.append((t, min(i for s, i in rows if s == t)))
    return out


def test_rate_thresholds_out_of_order():
    for seed, (kind, need, span) in enumerate([("threshold", 3, 9_000_000), ("both", 2, 12_000_000), ("limit", 4, 30_000_000), ("both", 1, 1), ("threshold", 5, 40_000_000)]):
        rng = random.Random(seed)
        rows = matches(rng, kind, need, span)
        out, each = run(pr.RateThresholds, dealt(rows, rng, 5000), 6000)
        assert [(r["t_us"], r["packet_id"]) for _, r in out] == plain_rates(rows, kind, need, span)
        assert all(not p.past.exists() and not p.waiting.exists() for p in each.values())  # nothing stays behind


def test_late_rows_are_accounted_for():
    rng = random.Random(3)
    rows = [((str(i % 3), "d", "a"), {"t_us": 1000 * t, "event_id": i}) for i, t in enumerate(rng.sample(range(500_000), 300))]

    def make():
        p = pr.DuplicateWindows(5_000_000)
        p.gives_late = True
        return p

    out, _ = run(make, dealt(rows, rng, 60_000), 10_000)  # the delay is far less than rows may lag
    late = {r["late_id"] for _, r in out if r["late_id"] is not None}
    counted = sum(r["dup_count"] + 1 for _, r in out if r["kind"] == "closed")
    assert late and counted + len(late) == len(rows)
    assert not late & {r["event_id"] for _, r in out if r["kind"] == "alert"}
    none, _ = run(make, dealt(rows, rng, 5_000), 10_000)
    assert all(r["late_id"] is None for _, r in none)


def test_rows_leave_with_the_first_watermark_beyond_them():
    """A row does not wait for later rows of its key; what stands behind relies on it."""
    rows = [(("s",), {"t_us": t * 1000, "event_id": t, "dst_ip": "d", "attack_type": "a", "kind": "alert", "dup_count": 0, "severity": "LOW"}) for t in (100, 5000)]
    tick = [(("other",), {**rows[0][1], "t_us": 4_000_000, "event_id": 9})]
    out, _ = run(lambda: pr.CorrelationGroups(600_000), [rows, tick, tick[:0]], 1000)
    came = {r["event_id"]: n for n, r in out if r["kind"] == "alert"}
    assert came[100] < came[5000]


def test_groups_and_chains():
    rng = random.Random(7)
    alerts = [(i, t, rng.choice("abc"), rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"])) for i, t in enumerate(sorted(rng.sample(range(1_000_000), 120)))]
    rows = [(("s",), {"t_us": t * 1000, "event_id": i, "dst_ip": "d", "attack_type": a, "kind": "alert", "dup_count": 0, "severity": s}) for i, t, a, s in alerts]
    width = 60_000_000
    grouped, _ = run(lambda: pr.CorrelationGroups(width), dealt(rows, rng, 5000), 6000)
    start, want = None, {}
    for i, t, a, s in alerts:
        new = start is None or t * 1000 > start + width
        if new:
            start, types, top = t * 1000, set(), 0
        types, top = types | {a}, max(top, pr.SEVERITY_RANK[s])
        want[i] = (start, new, sorted(types), top)
    assert {r["event_id"]: (r["group_start_us"], r["is_new_group"]) for _, r in grouped if r["kind"] == "alert"} == {i: v[:2] for i, v in want.items()}
    assert sum(r["kind"] == "group_closed" for _, r in grouped) == sum(v[1] for v in want.values())
    keyed = [((r["src_ip"], r["group_start_us"]), r) for _, r in grouped]
    chained, each = run(pr.AttackChains, [keyed], 1000)
    got = {r["event_id"]: (r["chain_attack_types"], r["composite_rank"]) for _, r in chained if r["kind"] == "alert"}
    assert got == {i: v[2:] for i, v in want.items()}
    assert all(not p.seen.exists() for p in each.values())
