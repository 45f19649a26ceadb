"""Keyed state for streams: duplicate windows, groups, chains, rate thresholds, flows, recent vectors, alert workflow.

Rows wait in state until the watermark has passed them and are then taken in event-time
order, so it does not matter in which micro-batch a row comes as long as it is not later
than the watermark's delay. What is kept besides is a few numbers per key; event-time
timers drop it once no row can touch it any more. A row without an id only moves the
watermark on (a heartbeat, or the end of the input).

Processors can stand in a chain: each hands on its rows in the micro-batch in which the watermark
passes them, with ``ts``, the watermark of that batch, as their event time; the next one orders
them by ``t_us`` again. The first of a chain can give late rows out instead of having them dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import RESOLUTION_TYPES, STATES, TRANSITIONS
from tidewatch.operators.correlate import SEVERITY_RANK
from tidewatch.operators.flows import FEATURES


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: columns of a late row: its time and id
LATE = "late_t_us long, late_id long"


def _widened(pdf: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    out = pdf.reindex(columns=columns).astype(object)
    return out.where(out.notna(), None)


#: rows that ``advance`` takes at a time; rows of one time stay together
PIECE_ROWS = 50_000


def _packed(pdf: pd.DataFrame) -> bytes:
    """Rows as one value for the state: a message of the Arrow stream format."""
    table = pa.Table.from_pandas(pdf, preserve_index=False).replace_schema_metadata(None)
    return _ipc(table)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _pieces(t: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts times in order into pieces of about PIECE_ROWS, nowhere between equal times; at least one, which may be empty."""
    a = 0
    while True:
        b = min(a + PIECE_ROWS, len(t))
        if b < len(t):
            b = int(np.searchsorted(t, t[b - 1], side="right"))
        yield a, b
        a = b
        if a >= len(t):
            return


class InOrder(StatefulProcessor):
    """Gives ``advance`` the rows of a key in event-time order, each once, when the watermark has passed them."""

    #: columns that are kept of a waiting row; ``t_us`` and then the row's id first
    row: str
    schema: str
    #: whether rows behind the watermark come out at once, with nothing but LATE set; for the first of a chain only
    gives_late = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows in blocks, not one by one: a value of the state costs the same whatever it holds
        self.waiting = handle.getListState("waiting", "block binary")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, key, rows: pd.DataFrame, now_us: int) -> list[tuple] | pd.DataFrame:
        """Take rows in order; then do what is due by ``now_us``. Rows of the result."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        names = _names(self.row)
        least, late = None, []
        for pdf in rows:
            pdf = pdf.loc[pdf[names[1]].notna(), names]
            if self.gives_late:
                behind = pdf["t_us"].to_numpy(np.int64) // 1000 < timerValues.getCurrentWatermarkInMs()
                late.append(pdf.loc[behind, names[:2]])
                pdf = pdf.loc[~behind]
            if len(pdf):
                self.waiting.appendValue((_packed(pdf),))
                first = int(pdf["t_us"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            self.due(least)
        if any(map(len, late)):
            out = pd.concat(late, ignore_index=True).set_axis(_names(LATE), axis=1)
            yield _widened(out, [*_names(self.schema), *_names(LATE)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # rows of the milliseconds whose timers have run out, so that each comes with the first watermark beyond it
        self.watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        now = self.watermark_us - 1001
        names = _names(self.row)
        table, order, t = None, np.empty(0, np.int64), np.empty(0, np.int64)
        if self.waiting.exists():
            blocks = [pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()]
            table = pa.concat_tables(blocks, promote_options="permissive")
            at, ids = (table.column(c).to_numpy().astype(np.int64) for c in names[:2])
            order = np.lexsort((ids, at))
            t = at[order]
            passed = int(np.searchsorted(t, now, side="right"))
            if passed:
                later = np.sort(order[passed:])
                self.waiting.put([(_ipc(table.take(pa.array(later))),)]) if len(later) else self.waiting.clear()
            if passed < len(t):
                self.due(int(t[passed]))
            order, t = order[:passed], t[:passed]
        for a, b in _pieces(t):
            rows = table.take(pa.array(order[a:b])).to_pandas() if b > a else pd.DataFrame(columns=names)
            # between pieces only what is before the next row is due
            out = self.advance(key, rows, now if b == len(t) else int(t[b - 1]) - 1)
            if len(out):
                out = out if isinstance(out, pd.DataFrame) else pd.DataFrame(out, columns=_names(self.schema))
                yield _widened(out, [*out.columns, *_names(LATE)]) if self.gives_late else out

    def due(self, at_us: int) -> None:
        """Call ``advance`` again when the watermark passes a time."""
        self.handle.registerTimer(at_us // 1000 + 1)

    def close(self) -> None:
        pass


class DuplicateWindows(InOrder):
    """Anchored windows per key: an ``alert`` row when a window opens, one ``closed`` row
    with the number of suppressed events when it ends."""

    row = "t_us long, event_id long"
    schema = "event_id long, src_ip string, dst_ip string, attack_type string, t_us long, kind string, dup_count long"

    def __init__(self, width_us: int):
        self.width = width_us

    def begin(self, handle):
        self.open = handle.getValueState("open", "anchor long, event_id long, seen long")

    def advance(self, key, rows, now_us):
        t, ids = rows["t_us"].to_numpy(np.int64), rows["event_id"].to_numpy(np.int64)
        state = self.open.get() if self.open.exists() else None
        out, i = [], 0

        def closed():
            return (state[1], *key, state[0], "closed", state[2] - 1)

        while i < len(t):
            if state is None or t[i] > state[0] + self.width:
                if state is not None:
                    out.append(closed())
                state = (int(t[i]), int(ids[i]), 0)
                out.append((state[1], *key, state[0], "alert", 0))
                self.due(state[0] + self.width)
            end = int(np.searchsorted(t, state[0] + self.width, side="right"))
            state = (state[0], state[1], state[2] + end - i)
            i = end
        if state is not None and now_us >= state[0] + self.width:
            out.append(closed())
            state = None
        self.open.update(state) if state is not None else self.open.clear()
        return out


def _moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class EmittedAlerts(DuplicateWindows):
    """Duplicate windows for the operators behind them: alerts with their severity; a ``closed`` row has the time at which its window ends."""

    row = "t_us long, event_id long, severity string"
    schema = "event_id long, src_ip string, dst_ip string, attack_type string, t_us long, kind string, dup_count long, severity string, ts timestamp"

    def advance(self, key, rows, now_us):
        severity = dict(zip(rows["event_id"], rows["severity"]))
        out = []
        for event_id, *key_, t, kind, dup_count in super().advance(key, rows, now_us):
            end = kind == "closed"
            out.append((event_id, *key_, t + self.width if end else t, kind, dup_count, None if end else severity[event_id], _moment(self.watermark_us)))
        return out


class CorrelationGroups(InOrder):
    """Anchored windows per source over emitted alerts: each alert with the start of its group, and one
    ``group_closed`` row when a group ends. ``closed`` rows of the step before pass through."""

    row = "t_us long, event_id long, dst_ip string, attack_type string, kind string, dup_count long, severity string"
    schema = (
        "src_ip string, event_id long, dst_ip string, attack_type string, t_us long, kind string, dup_count long, severity string, "
        "group_start_us long, is_new_group boolean, ts timestamp"
    )

    def __init__(self, width_us: int):
        self.width = width_us

    def begin(self, handle):
        self.open = handle.getValueState("open", "anchor long, event_id long")

    def advance(self, key, rows, now_us):
        state = self.open.get() if self.open.exists() else None
        out, ts = [], _moment(self.watermark_us)

        def ended():
            return (key[0], state[1], None, None, state[0] + self.width, "group_closed", 0, None, state[0], False, ts)

        for t, event_id, dst, attack, kind, dups, severity in rows.itertuples(index=False, name=None):
            if kind != "alert":
                out.append((key[0], event_id, dst, attack, t, kind, dups, severity, -1, False, ts))
                continue
            new = state is None or t > state[0] + self.width
            if new:
                if state is not None:
                    out.append(ended())
                state = (int(t), int(event_id))
                self.due(state[0] + self.width)
            out.append((key[0], event_id, dst, attack, t, kind, dups, severity, state[0], new, ts))
        if state is not None and now_us >= state[0] + self.width:
            out.append(ended())
            state = None
        self.open.update(state) if state is not None else self.open.clear()
        return out


class AttackChains(InOrder):
    """Attack types and top severity so far in a group, at each of its alerts; the group's end gives them once more and drops the state."""

    row = "t_us long, event_id long, attack_type string, kind string, dup_count long, severity string, is_new_group boolean"
    schema = (
        "src_ip string, group_start_us long, event_id long, t_us long, kind string, dup_count long, is_new_group boolean, "
        "chain_attack_types array<string>, composite_rank int, attack_chain boolean"
    )
    ORDER = ("alert", "closed", "group_closed")  # at one time

    def begin(self, handle):
        self.seen = handle.getValueState("seen", "types array<string>, top int")

    def advance(self, key, rows, now_us):
        types, top = (set(self.seen.get()[0]), self.seen.get()[1]) if self.seen.exists() else (set(), 0)
        out, ended = [], False
        rows = rows.assign(place=[self.ORDER.index(k) for k in rows["kind"]]).sort_values(["t_us", "place", "event_id"])
        for t, event_id, attack, kind, dups, severity, new, _ in rows.itertuples(index=False, name=None):
            if kind == "alert":
                types.add(attack)
                top = max(top, SEVERITY_RANK.get(severity, 1))
            ended |= kind == "group_closed"
            have = sorted(types) if kind != "closed" else []
            out.append((*key, event_id, t, kind, dups, new, have, top if have else None, len(have) >= 2))
        if types and not ended:
            self.seen.update((sorted(types), top))
        else:
            self.seen.clear()
        return out


class RateThresholds(InOrder):
    """Matches of one rule and tracked address to rate alerts.

    The state is the times of the last matches, as many as the rule counts, and where the rule alerts once
    (``both``) or the first few times (``limit``) per span the start of the current span with its number of alerts.
    """

    row = "t_us long, packet_id long, threshold_type string, need long, span long"
    schema = "rule_id string, tracked string, threshold_type string, t_us long, packet_id long"

    def begin(self, handle):
        self.past = handle.getValueState("past", "times array<long>, anchor long, given long, until long")

    def advance(self, key, rows, now_us):
        times, anchor, given, until = self.past.get() if self.past.exists() else ([], None, 0, 0)
        times, out = list(times), []
        if len(rows):
            kind, need, span = rows["threshold_type"].iloc[0], int(rows["need"].iloc[0]), int(rows["span"].iloc[0])
            t, ids = rows["t_us"].to_numpy(np.int64), rows["packet_id"].to_numpy(np.int64)
            if kind == "limit":
                for at, i in zip(t.tolist(), ids.tolist()):
                    if anchor is None or at > anchor + span:
                        anchor, given = at, 0
                    if given < need:
                        given += 1
                        out.append((*key, kind, at, i))
            else:
                every = np.concatenate([np.array(times, dtype=np.int64), t])
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                last = np.r_[first[1:], len(t)] - 1 + len(times)  # rows of one time count together
                back = last - need + 1
                reached = (back >= 0) & (every[np.maximum(back, 0)] >= every[last] - span)
                for at, i in zip(t[first[reached]].tolist(), ids[first[reached]].tolist()):
                    if kind == "threshold" or anchor is None or at > anchor + span:
                        anchor = at
                        out.append((*key, kind, at, i))
                times = every[max(0, len(every) - need) :].tolist()
            until = int(t[-1]) + span
            self.due(until)
        self.past.update((times, anchor, given, until)) if now_us <= until else self.past.clear()
        return out


# Running statistics of a number of values: how many, their mean, the squared distances from
# it, least and greatest. Two of them merge without loss of digits.
Stats = tuple[float, float, float, float, float]
NOTHING: Stats = (0.0, 0.0, 0.0, np.inf, -np.inf)


def stats_of(x: np.ndarray, piece: np.ndarray, pieces: int) -> np.ndarray:
    """Stats of the values of each piece, one piece a row; `piece` is in order."""
    out = np.tile(NOTHING, (pieces, 1))
    if len(x):
        x = x.astype(float)
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        size = np.diff(np.r_[first, len(x)])
        mean = np.add.reduceat(x, first) / size
        apart = np.add.reduceat((x - np.repeat(mean, size)) ** 2, first)
        out[piece[first]] = np.column_stack([size, mean, apart, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)])
    return out


def stats(x: np.ndarray) -> Stats:
    return tuple(stats_of(x, np.zeros(len(x), np.int64), 1)[0].tolist())


def joined(a: Stats, b: Stats) -> Stats:
    n = a[0] + b[0]
    if n == 0:
        return NOTHING
    apart = b[1] - a[1]
    return (n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4]))


def _spread(n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return np.where(n > 1, np.sqrt(apart / np.maximum(n, 1.0)), 0.0)


def _sides(length: np.ndarray, header: np.ndarray, t: np.ndarray, piece: np.ndarray, pieces: int) -> np.ndarray:
    """One direction of each piece, one piece a row: length statistics, gap statistics, bytes, header bytes, first and last time."""
    out = np.tile([*NOTHING, *NOTHING, 0.0, 0.0, np.nan, np.nan], (pieces, 1))
    if len(t):
        same = piece[1:] == piece[:-1]
        out[:, :5] = stats_of(length, piece, pieces)
        out[:, 5:10] = stats_of(np.diff(t)[same], piece[1:][same], pieces)
        first = np.flatnonzero(np.r_[True, ~same])
        last = np.r_[first[1:], len(t)] - 1
        out[piece[first], 10:] = np.column_stack([np.add.reduceat(length, first), np.add.reduceat(header, first), t[first], t[last]])
    return out


def _join_sides(a: list[float], b: list[float]) -> list[float]:
    """Two successive pieces of one direction; the gap between them counts too."""
    if a[0] == 0:
        return b
    if b[0] == 0:
        return a
    gaps = joined(joined(tuple(a[5:10]), stats(np.array([b[12] - a[13]]))), tuple(b[5:10]))
    return [*joined(tuple(a[:5]), tuple(b[:5])), *gaps, a[10] + b[10], a[11] + b[11], a[12], b[13]]


def _features(fwd: np.ndarray, bwd: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """The features of flows, one flow a row of the arrays."""

    def share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        return np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1.0), 0.0)

    out = dict.fromkeys(FEATURES, np.zeros(len(start)))
    dur = (end - start) / 1e6
    pkts, size = fwd[:, 0] + bwd[:, 0], fwd[:, 10] + bwd[:, 10]
    out["flow_duration"] = dur
    for p, s in (("fwd", fwd), ("bwd", bwd)):
        n = s[:, 0]
        some, more = n > 0, n > 1
        out[f"total_{p}_packets"], out[f"total_length_{p}_packets"] = n, s[:, 10]
        out[f"{p}_header_length"] = s[:, 11]
        out[f"{p}_packet_length_max"], out[f"{p}_packet_length_min"] = (np.where(some, s[:, k], 0.0) for k in (4, 3))
        out[f"{p}_packet_length_mean"] = out[f"avg_{p}_segment_size"] = share(s[:, 10], n)
        out[f"{p}_packet_length_std"] = _spread(n, s[:, 2])
        span = np.where(more, s[:, 13] - s[:, 12], 0.0)
        out[f"{p}_iat_total"], out[f"{p}_iat_mean"] = span / 1e6, share(span, n - 1) / 1e6
        out[f"{p}_iat_std"] = np.where(more, _spread(s[:, 5], s[:, 7]), 0.0) / 1e6
        out[f"{p}_iat_max"], out[f"{p}_iat_min"] = (np.where(more, s[:, k], 0.0) / 1e6 for k in (9, 8))
        out[f"{p}_packets_per_sec"] = share(n, dur)
    out["flow_bytes_per_sec"], out["flow_packets_per_sec"] = share(size, dur), share(pkts, dur)
    out["down_up_ratio"] = share(bwd[:, 10], fwd[:, 10])
    out["average_packet_size"] = share(size, pkts)
    out["min_packet_length"], out["max_packet_length"] = np.minimum(fwd[:, 3], bwd[:, 3]), np.maximum(fwd[:, 4], bwd[:, 4])
    for k, name in enumerate(("fin", "syn", "rst", "psh", "ack", "urg")):
        out[f"{name}_flag_count"] = flags[:, k]
    return {f: out[f] for f in FEATURES}


class Flows(InOrder):
    """Packets of one 5-tuple to finished flows with their features."""

    flags = ["flag_fin", "flag_syn", "flag_rst", "flag_psh", "flag_ack", "flag_urg"]
    row = "t_us long, packet_id long, is_forward boolean, length long, header_length long, protocol string, " + ", ".join(f"{f} boolean" for f in flags)
    schema = "flow_id string, flow_key string, start_us long, end_us long, pkt_count long, " + ", ".join(
        f"{f} double" for f in FEATURES
    )

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def begin(self, handle):
        self.flow = handle.getValueState("flow", "start long, first long, last long, fwd array<double>, bwd array<double>, flags array<double>")

    def _emit(self, key, start, first, last, fwd, bwd, flags) -> pd.DataFrame:
        """Finished flows, one a row of the arrays."""
        columns = {
            "flow_id": [f"{key[0]}@{k}" for k in first.tolist()], "flow_key": key[0], "start_us": start, "end_us": last,
            "pkt_count": (fwd[:, 0] + bwd[:, 0]).astype(np.int64),
        }
        return pd.DataFrame(columns | _features(fwd, bwd, flags, start, last))

    def advance(self, key, rows, now_us):
        t, ids = rows["t_us"].to_numpy(np.int64), rows["packet_id"].to_numpy(np.int64)
        state = self.flow.get() if self.flow.exists() else None
        held, out = None, []
        if state is not None:
            held = [np.array([x]) for x in state[:3]] + [np.array([x], dtype=float) for x in state[3:]]
            if len(t) and t[0] - state[2] >= self.idle:
                out.append(self._emit(key, *held))
                state = held = None
        if len(t):
            fwd = rows["is_forward"].to_numpy(bool)
            length, header = rows["length"].to_numpy(np.int64), rows["header_length"].to_numpy(np.int64)
            marks = rows[self.flags].to_numpy(bool).astype(float)
            ends = ((marks[:, 0] + marks[:, 2]) > 0) & (rows["protocol"].to_numpy() == "TCP")
            cut = np.r_[True, ends[:-1] | (np.diff(t) >= self.idle)]
            begins, piece = np.flatnonzero(cut), np.cumsum(cut) - 1
            n, last = len(begins), np.r_[begins[1:], len(t)] - 1
            sides = [_sides(length[f], header[f], t[f], piece[f], n) for f in (fwd, ~fwd)]
            found = [t[begins], ids[begins], t[last], *sides, np.add.reduceat(marks, begins, axis=0)]
            if state is not None:
                found[0][0], found[1][0] = state[:2]
                for k in (3, 4):
                    found[k][0] = _join_sides(list(state[k]), found[k][0].tolist())
                found[5][0] += np.array(state[5], dtype=float)
            done = n if ends[-1] else n - 1
            if done:
                out.append(self._emit(key, *(x[:done] for x in found)))
            held = None if ends[-1] else [x[done:] for x in found]
        if held is not None and now_us - held[2][0] >= self.idle:
            out.append(self._emit(key, *held))
            held = None
        if held is None:
            self.flow.clear()
        else:
            self.flow.update((*(int(x[0]) for x in held[:3]), *(x[0].tolist() for x in held[3:])))
            self.due(int(held[2][0]) + self.idle)
        return pd.concat(out, ignore_index=True) if out else []


class RecentVectors(InOrder):
    """The last ``size`` vectors of a source at each flow."""

    row = "t_us long, event_id long, vector array<double>"
    schema = "event_id long, recent array<array<double>>, window_complete boolean"

    def __init__(self, size: int = 10, keep_ms: int = 86_400_000):
        self.size, self.keep = size, keep_ms * 1000

    def begin(self, handle):
        self.last = handle.getValueState("last", "vectors array<array<double>>, until long")

    def advance(self, key, rows, now_us):
        held, until = ([list(v) for v in self.last.get()[0]], self.last.get()[1]) if self.last.exists() else ([], 0)
        every = held + [np.asarray(v).tolist() for v in rows["vector"]]
        base = len(held)
        recent = [every[max(0, base + i + 1 - self.size) : base + i + 1] for i in range(len(rows))]
        if len(rows):
            until = int(rows["t_us"].iloc[-1]) + self.keep
            self.due(until)
        if now_us >= until:
            self.last.clear()
        else:
            self.last.update((every[len(every) - self.size + 1 :] if len(every) >= self.size else every, until))
        return [(int(i), r, len(r) >= self.size) for i, r in zip(rows["event_id"], recent)]


class Workflow(InOrder):
    """Alert status under a stream of analyst actions; an alert without actions for ``keep_ms`` is forgotten."""

    row = "t_us long, action_id long, action string, note string, resolution_type string"
    schema = "action_id long, alert_id string, previous_status string, accepted boolean, new_status string"

    #: numbers of the actions; the state each leads to from each, and whether it is taken. The last row is of what is not legal.
    CODES = {action: k for k, action in enumerate(TRANSITIONS)}
    TAKEN = [[s in sources for s in STATES] for sources, _, _ in TRANSITIONS.values()] + [[False] * len(STATES)]
    TURNS = [[STATES.index(target) if s in sources else k for k, s in enumerate(STATES)] for sources, target, _ in TRANSITIONS.values()] + [[*range(len(STATES))]]

    def __init__(self, keep_ms: int = 365 * 86_400_000):
        self.keep = keep_ms * 1000

    def begin(self, handle):
        self.status = handle.getValueState("status", "status string, until long")

    def advance(self, key, rows, now_us):
        now, until = self.status.get() if self.status.exists() else (STATES[0], 0)
        out = []
        if len(rows):
            code = rows["action"].map(self.CODES).fillna(len(self.CODES)).to_numpy(np.int64)
            noted = (rows["note"].fillna("").str.strip() != "").to_numpy(bool)
            illegal = (rows["action"] == "resolve").to_numpy(bool) & ~(rows["resolution_type"].isin(list(RESOLUTION_TYPES)).to_numpy(bool) & noted)
            code[illegal] = len(self.CODES)
            state, before = STATES.index(now), []
            for turn in map(self.TURNS.__getitem__, code.tolist()):
                before.append(state)
                state = turn[state]
            after = np.array(self.TURNS)[code, before]
            names = np.array(STATES, dtype=object)
            out = pd.DataFrame({
                "action_id": rows["action_id"].to_numpy(np.int64), "alert_id": key[0], "previous_status": names[before],
                "accepted": np.array(self.TAKEN)[code, before], "new_status": names[after],
            })
            now, until = STATES[state], int(rows["t_us"].iloc[-1]) + self.keep
            self.due(until)
        self.status.update((now, until)) if now_us < until else self.status.clear()
        return out
