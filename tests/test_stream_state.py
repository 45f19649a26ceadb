import numpy as np
import pandas as pd
import pytest

from tidewatch.streaming import processors as pr


class Cell:
    def __init__(self):
        self.items, self.appended = [], 0

    def exists(self):
        return bool(self.items)

    def get(self):
        return self.items[0] if self.single else iter(list(self.items))

    def put(self, items):
        self.items = list(items)

    def appendValue(self, item):
        self.items.append(item)
        self.appended += 1

    def update(self, item):
        self.items = [item]

    def clear(self):
        self.items = []


class Handle:
    """The parts of Spark's handle that the processors use, in memory."""

    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        self.list = Cell()
        self.list.single = False
        return self.list

    def getValueState(self, name, schema):
        cell = Cell()
        cell.single = True
        return cell

    def registerTimer(self, ms):
        self.timers.add(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def driven(processor, frames, marks, key=("k",)):
    """All rows that come out, and how many values the list of waiting rows was given."""
    handle, out = Handle(), []
    processor.init(handle)
    for frame, mark in zip(frames, marks):
        out += list(processor.handleInputRows(key, iter([frame]), Watermark(0)) or [])
        out += list(processor.handleExpiredTimer(key, Watermark(mark), None))
    return [tuple(r) for f in out for r in f.itertuples(index=False, name=None)], handle, max((len(f) for f in out), default=0)


@pytest.mark.parametrize("piece", [4, 50_000])
def test_rows_wait_in_blocks_and_are_taken_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(pr, "PIECE_ROWS", piece)
    n = 60
    t = np.random.default_rng(1).integers(0, 20, n) * 1_000_000  # many rows of one time
    rows = pd.DataFrame({"t_us": t, "event_id": np.arange(n), "vector": [[float(i), 0.5] for i in range(n)]})
    got, handle, longest = driven(pr.RecentVectors(3), [rows[:40], rows[40:].assign(t_us=lambda r: r["t_us"] + 12_000_000), rows[:0]], [12_000, 25_000, 10**7])
    late = rows.assign(t_us=np.r_[t[:40], t[40:] + 12_000_000]).sort_values(["t_us", "event_id"])["event_id"].tolist()
    assert [(i, [v[0] for v in r]) for i, r, _ in got] == [(i, [float(x) for x in late[max(0, k - 2) : k + 1]]) for k, i in enumerate(late)]
    assert handle.list.appended == 2 and not handle.list.items  # one value a batch, not one a row
    assert piece > 4 or longest < 30  # what comes out at once does not grow with the rows of a key


@pytest.mark.parametrize("piece", [1, 5, 50_000])
def test_windows_and_rates_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(pr, "PIECE_ROWS", piece)
    t = np.sort(np.random.default_rng(2).integers(0, 60, 80)) * 1_000_000
    rows = pd.DataFrame({"t_us": t, "event_id": np.arange(80)})
    got, _, _ = driven(pr.DuplicateWindows(7_000_000), [rows[::-1], rows[:0]], [30_000, 10**7], ("a", "b", "c"))
    anchor, want = None, []
    for i, at in enumerate(t.tolist()):
        if anchor is None or at > anchor[1] + 7_000_000:
            want.append([i, at, 0])
            anchor = (i, at)
        else:
            want[-1][2] += 1
    assert [[r[0], r[4], r[6]] for r in got if r[5] == "closed"] == want
    rate = rows.rename(columns={"event_id": "packet_id"}).assign(threshold_type="threshold", need=4, span=3_000_000)
    got, _, _ = driven(pr.RateThresholds(), [rate, rate[:0]], [30_000, 10**7], ("9", "a"))
    assert [r[3] for r in got] == [at for at in sorted(set(t.tolist())) if ((t <= at) & (t >= at - 3_000_000)).sum() >= 4]


def packets(n, seed):
    rng = np.random.default_rng(seed)
    flags = {f: rng.random(n) < 0.15 for f in pr.Flows.flags}
    fields = {"length": rng.integers(60, 1500, n), "header_length": 20, "protocol": np.where(rng.random(n) < 0.8, "TCP", "UDP")}
    return pd.DataFrame({"t_us": np.sort(rng.integers(0, 40 * n, n)) * 100_000, "packet_id": np.arange(n), "is_forward": rng.random(n) < 0.6, **fields, **flags})


@pytest.mark.parametrize("piece", [1, 7, 50_000])
def test_flows_of_a_key_are_taken_together(monkeypatch, piece):
    """Each flow against its own packets, whatever the pieces; figures of many flows are made at once."""
    monkeypatch.setattr(pr, "PIECE_ROWS", piece)
    calls, features, idle = [], pr._features, 10_000_000
    monkeypatch.setattr(pr, "_features", lambda *a: calls.append(1) or features(*a))
    rows = packets(600, 3)
    got, _, _ = driven(pr.Flows(idle), [rows[:250], rows[250:], rows[:0]], [rows["t_us"][249] // 1000, 10**6, 10**9])
    ends = (rows["flag_fin"] | rows["flag_rst"]) & (rows["protocol"] == "TCP")
    number = (ends.shift(fill_value=False) | (rows["t_us"].diff() >= idle)).cumsum()
    names = pr._names(pr.Flows.schema)
    table = {r[0]: dict(zip(names, r)) for r in got}
    assert len(got) == len(table) == number.nunique() > 100 and (piece < 50_000 or len(calls) <= 6)
    for _, flow in rows.groupby(number):
        row = table[f"k@{flow['packet_id'].iloc[0]}"]
        assert (row["start_us"], row["end_us"], row["pkt_count"]) == (flow["t_us"].iloc[0], flow["t_us"].iloc[-1], len(flow))
        for p, side in (("fwd", flow[flow["is_forward"]]), ("bwd", flow[~flow["is_forward"]])):
            gaps = np.diff(side["t_us"]) / 1e6
            want = {"packet_length_mean": side["length"].mean(), "packet_length_std": side["length"].std(ddof=0), "packet_length_min": side["length"].min()}
            want |= {"iat_mean": gaps.mean(), "iat_std": gaps.std(), "iat_max": gaps.max(), "iat_total": gaps.sum()} if len(gaps) else {"iat_std": 0, "iat_min": 0}
            for c, v in want.items():
                assert row[f"{p}_{c}"] == pytest.approx(v if len(side) else 0, abs=1e-9), c
        assert row["syn_flag_count"] == flow["flag_syn"].sum() and row["max_packet_length"] == flow["length"].max()


@pytest.mark.parametrize("piece", [1, 7, 50_000])
def test_actions_of_an_alert_are_taken_together(monkeypatch, piece):
    monkeypatch.setattr(pr, "PIECE_ROWS", piece)
    rng, n = np.random.default_rng(4), 500
    pick = lambda x: [x[k] for k in rng.integers(0, len(x), n)]
    rows = pd.DataFrame({
        "t_us": np.arange(n) * 1000, "action_id": np.arange(n), "action": pick([*pr.TRANSITIONS, "unheard of", None]),
        "note": pick(["text", " \t", "", None]), "resolution_type": pick([*pr.RESOLUTION_TYPES, "wrong", None]),
    })
    handle, processor = Handle(), pr.Workflow()
    processor.init(handle)
    assert isinstance(processor.advance(("a1",), rows, 0), pd.DataFrame)  # a table, not a row at a time
    got, _, _ = driven(pr.Workflow(), [rows[:200], rows[200:]], [200, 10**6], ("a1",))
    now, want = "open", []
    for _, i, action, note, kind in rows.itertuples(index=False, name=None):
        sources, target, _ = pr.TRANSITIONS.get(action, ([], None, None))
        ok = (action != "resolve" or (kind in pr.RESOLUTION_TYPES and bool((note or "").strip()))) and now in sources
        want.append((i, "a1", now, ok, target if ok else now))
        now = want[-1][-1]
    assert got == want and 0 < sum(r[3] for r in want) < n
