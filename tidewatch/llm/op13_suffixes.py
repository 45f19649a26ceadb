"""Removal of byte strings that occur again anywhere, by a distributed difference-cover suffix sort.

A window is WIDTH consecutive bytes of one document. Every byte goes that lies in a window whose
bytes also start at another place, in the same document or in another.

*Sampling.* The anchor of a window is the place of the least hash among the first SPAN runs of GRAM
bytes in it, the leftmost among equals: equal windows have equal anchors. About two bytes in SPAN
are anchors, so what is sorted is a small share of all suffixes. All windows of an anchor share
the CORE bytes behind it. Anchors whose CORE bytes occur once (by a merged sketch, which never
underestimates) have no repeated window and are discarded. The windows of the others, united,
are the segments that are sorted.

*Sorting.* In a segment, the anchor that follows place s is that of the window at s + 1. So a suffix
is a chain of symbols, each the LOOK bytes from an anchor on, which settle where the next anchor
lies; the order of chains is the order of the bytes. Windows that a block of texts repeats are settled there, and
only the first of them is sorted: copies and texts that repeat a word are cut down first. Symbols get ranks, and then, as in the DC3
algorithm: chains are numbered from their end, triples of symbols are sorted at the
places that are 1 or 2 modulo 3, and get names; unless the names tell apart all that differs within
WIDTH bytes, they refine the symbols of the next level, a third as deep, in which only suffixes that
are still alike are sorted; the places that are 0 modulo 3 are merged in with the help of the ranks behind
them: against places 2 by (symbol, next rank), against places 1 by (symbol, symbol, next rank),
counting how many of the other kind come before. Each sort goes over distinct keys with their numbers, ranged
over tasks; no key's rows meet in one task.

*Comparing.* In the order of ranks, neighbours with equal CORE bytes make a class. Anchors that
are equal in all that their windows cover become one row with a number first. Inside a class
the windows at each distance before the anchor are compared by what lies left of the anchor and
behind its CORE bytes; what occurs twice is removed.

A symbol's digest, a core's and a window's rest are 128 or 64 bits long (the latter only among
rows of one class). Null texts are empty. Texts of any length are read whole; texts shorter than a
window keep all their bytes. Repeated rows are documents of their own, so all but short ones lose
everything. Ids are only carried along, null or not. An empty table gives no rows. Columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.op3_substrings import Repeated, block_keys, cell_count, sketch
from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import BASES, BYTE_CODES, U64, Block, batches_of, mix, ragged, slices, span_hashes
from tidewatch.session import cut_lineage, discard

WIDTH = 400
#: Sketch cells for each byte of text.
CELLS_PER_BYTE = 1 / 8
#: Rows of one or more whole classes that are compared at once.
CLASS_ROWS = 20_000


@dataclass(frozen=True)
class Shape:
    """Lengths that follow from that of a window."""

    width: int

    @property
    def gram(self) -> int:
        return max(1, min(16, self.width // 4))

    @property
    def span(self) -> int:
        return max(1, min(160, self.width * 2 // 5))

    @property
    def look(self) -> int:
        return self.span + self.gram

    @property
    def core(self) -> int:
        return self.width - self.span + 1

    @property
    def levels(self) -> int:
        """So many triples of triples reach over a window even if each symbol is one byte apart."""
        return next(k for k in range(1, 64) if 3**k >= self.width)


def anchor_of(data: np.ndarray, shape: Shape) -> np.ndarray:
    """The anchor of a window at each place from which `look` - 1 bytes follow."""
    n = len(data) - shape.gram + 1
    if n < shape.span:
        return np.empty(0, dtype=np.int64)
    first = np.arange(n)
    high = span_hashes(BYTE_CODES[0][data], first, first + shape.gram) & ~U64(0xFFFFFFFF)
    least, done = high | first.astype(U64), 1
    while done < shape.span:  # a sliding minimum by doubling; the place decides among equals
        step = min(done, shape.span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return (least & U64(0xFFFFFFFF)).astype(np.int64)


def windows(block: Block, shape: Shape) -> np.ndarray:
    """Places of the windows that lie in one document."""
    size = np.maximum(np.diff(block.offsets) - shape.width + 1, 0)
    return ragged(block.offsets[:-1], size)


def firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)


def cores(data: np.ndarray, anchors: np.ndarray, shape: Shape) -> np.ndarray:
    return span_hashes(BYTE_CODES[1][data], anchors, anchors + shape.core, lane=1)


def core_keys(shape: Shape):
    """A block's cores, one for each anchor."""

    def keys(block: Block) -> np.ndarray:
        at = windows(block, shape)
        if not len(at):
            return np.empty(0, dtype=U64)
        anchor = anchor_of(block.data, shape)[at]
        return cores(block.data, anchor[firsts(anchor)], shape)

    return keys


MARKED = """row long, base long, n_bytes long, sha256 string, text binary, known array<long>, many array<long>,
    at array<int>, follow array<int>, low array<int>, high array<int>, core array<long>"""
ANCHORS = ("at", "follow", "low", "high", "core")


def seen_before(block: Block, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether an earlier one of the block is equal, and whether any is."""
    first, second = (span_hashes(BYTE_CODES[lane][block.data], p, p + width, lane) for lane in (0, 1))
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    later, some = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    later[order[1:]] = same
    some[order[:-1]] = same
    return later, some | later


def marked_block(block: Block, known: Repeated, shape: Shape) -> tuple[dict[int, tuple[np.ndarray, ...]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """What is to be sorted and what is settled, by document.

    To be sorted: the anchors' places, followers (-1: none), least and greatest distance of a window before (-1: none)
    and cores. Settled: (place, count) of runs of windows that are repeated within the block; only the first
    of equal windows is sorted, so copies and texts that repeat a word are cut down to what differs.
    """
    p = windows(block, shape)
    if not len(p):
        return {}, {}
    anchor = anchor_of(block.data, shape)
    own = anchor[p]
    begin = firsts(own)
    repeated = known(cores(block.data, own[begin], shape))
    p = p[np.repeat(repeated, np.diff(np.append(begin, len(own))))]
    if not len(p):
        return {}, {}
    doc = np.searchsorted(block.offsets, p, side="right") - 1
    later, some = seen_before(block, p, shape.width)
    settled = by_document(doc[some], p[some] - block.offsets[doc[some]])
    p, doc = p[~later], doc[~later]
    own = anchor[p]
    begin = firsts(own)
    anchors = own[begin]
    core = cores(block.data, anchors, shape)
    high, low = anchors - p[begin], anchors - p[np.append(begin[1:], len(p)) - 1]
    # Windows that touch make a segment; documents are apart, as no window crosses their border.
    cut = np.concatenate([[True], (p[1:] > p[:-1] + shape.width) | (doc[1:] != doc[:-1])])
    start, stop = p[cut], p[np.append(np.flatnonzero(cut)[1:], len(p)) - 1] + shape.width
    inside = ragged(start, stop - start - shape.look + 2)
    element = anchor[inside]
    element = element[firsts(element)]
    segment = np.searchsorted(start, element, side="right") - 1
    goes_on = element + shape.look <= stop[segment]
    follow = np.full(len(element), -1)
    follow[goes_on] = np.searchsorted(element, anchor[element[goes_on] + 1])
    place = np.searchsorted(element, anchors)
    lows, highs, hashes = np.full(len(element), -1), np.full(len(element), -1), np.zeros(len(element), dtype=np.int64)
    lows[place], highs[place], hashes[place] = low, high, core.view(np.int64)
    border = np.searchsorted(element, block.offsets)
    out = {}
    for d in np.flatnonzero(np.diff(border)).tolist():
        a, b = border[d], border[d + 1]
        out[d] = (element[a:b] - block.offsets[d], np.where(follow[a:b] < 0, -1, follow[a:b] - a), lows[a:b], highs[a:b], hashes[a:b])
    return out, settled


def by_document(doc: np.ndarray, place: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(begin, length) of the runs of places that go up by one, of each document."""
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])])) if len(doc) else np.empty(0, dtype=np.int64)
    length = np.diff(np.append(begin, len(doc)))
    owner, cut = np.unique(doc[begin], return_index=True)
    return {d: x for d, *x in zip(owner.tolist(), np.split(place[begin], cut[1:]), np.split(length, cut[1:]))}


def marked(docs: DataFrame, shape: Shape, texts: bool) -> DataFrame:
    """All rows of `docs` (id, text) with a number of their own, and the anchors of those that have segments.

    The text stays with rows that have segments, or with all if `texts`.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cell_count(size, CELLS_PER_BYTE)
    known = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), cells, block_keys(core_keys(shape))))
    schema = docs.select("id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        base = row
        for batch in batches:
            for first, end, data, offsets in batches_of(batch, "text"):
                block = Block(first, data, offsets)
                found, settled = marked_block(block, known.value, shape)
                n = end - first
                rows = {k: [] for k in ("base", "sha256", "text", "known", "many", *ANCHORS)}
                for d in range(n):
                    text = data[offsets[d] : offsets[d + 1]].tobytes()
                    parts = found.get(d)
                    rows["base"].append(base)
                    rows["sha256"].append(hashlib.sha256(text).hexdigest())
                    rows["text"].append(text if texts or parts or d in settled else None)
                    for name, values in zip(("known", "many"), settled.get(d) or [None, None]):
                        rows[name].append(values)
                    for name, values in zip(ANCHORS, parts or [None] * len(ANCHORS)):
                        rows[name].append(values)
                    base += len(parts[0]) if parts else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, n), pa.array(np.arange(row, row + n)), pa.array(rows["base"], pa.int64()), pa.array(np.diff(offsets)),
                        pa.array(rows["sha256"], pa.string()), pa.array(rows["text"], pa.binary()),
                        *(pa.array(rows[k], pa.list_(pa.int32() if k in ANCHORS[:4] else pa.int64())) for k in ("known", "many", *ANCHORS)),
                    ],
                    [schema.names[0], "row", "base", "n_bytes", "sha256", "text", "known", "many", *ANCHORS],
                )
                row += n

    kind = schema[0].dataType.simpleString()
    # Texts are most of it; a stronger codec than the session's halves them.
    return cut_lineage(docs.select("id", "text").mapInArrow(run, f"id {kind}, {MARKED}"), "suffixes-marked", "zstd")


def jumps(follow: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps to the chain's end, and the anchors 3 ** level, twice and three times as many steps on (-1: none)."""
    n = len(follow)
    go = np.append(np.where(follow < 0, n, follow), n)  # the end follows itself
    steps, jump = (go < n).astype(np.int64), go
    while (jump < n).any():
        steps = steps + steps[jump]
        jump = jump[jump]
    for _ in range(level):
        go = go[go[go]]
    return steps[:n], *(np.where(x[:n] == n, -1, x[:n]) for x in (go, go[go], go[go[go]]))


Chains = Callable[[int], DataFrame]


def chains_of(rows: DataFrame) -> Chains:
    """For a level, a row for each anchor: id, steps to the chain's end, ids 3 ** level (one) and twice as many steps on
    (two) as distances, and the bytes that a triple of such steps goes (reach); 0 where the chain ends before.
    """

    def at_level(level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole)):
                a = Anchors(batch)
                steps, one, two, three = jumps(np.where(a.column("follow") < 0, -1, a.column("follow") + a.place - a.index), level)
                at = a.column("at")
                far = (np.where(one < 0, 0, one - a.place), np.where(two < 0, 0, two - a.place), np.where(three < 0, 0, at[three] - at))
                yield pa.RecordBatch.from_arrays([pa.array(a.ids), *map(pa.array, (steps, *far))], ["id", "steps", "one", "two", "reach"])

        return rows.select("base", "at", "follow").mapInArrow(run, "id long, steps long, one long, two long, reach long")

    return at_level


def symbols(rows: DataFrame, shape: Shape, whole: bool) -> DataFrame:
    """(symbol) of each anchor, its bytes if `whole`, else (id, digest) of them. A symbol is shorter at its text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            a = Anchors(batch)
            begin, end = a.starts + a.column("at"), np.minimum(a.starts + a.column("at") + shape.look, a.ends)
            if whole:
                yield pa.RecordBatch.from_arrays([binaries(a.data, begin, end - begin)], ["symbol"])
            else:
                text = a.data.tobytes()
                digest = [hashlib.md5(text[x:y]).digest() for x, y in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(digest, pa.binary())], ["id", "digest"])

    return rows.select("base", "text", "at").mapInArrow(run, "symbol binary" if whole else "id long, digest binary")


class Anchors:
    """The anchors of some rows of `marked` one after another, and the rows' texts, if there, as one array."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        n = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.row))
        self.index = self.place - np.repeat(np.cumsum(n) - n, n)  # in its row
        self.ids = batch.column("base").to_numpy(zero_copy_only=False)[self.row] + self.index
        if "text" in batch.schema.names:
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            self.data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            self.starts, self.ends = offsets[:-1][self.row], offsets[1:][self.row]

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of an array of bytes as an Arrow column."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    content = np.ascontiguousarray(data[ragged(start, size)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(content)]).cast(pa.binary())


def ranked(rows: DataFrame, keys: list[str], counts: dict[str, Column], kept: Callable[[DataFrame, str], DataFrame], name: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """The distinct keys (or `keep` made of them) with each count's sum at the key, and `before_<count>`: at all lesser keys.

    Keys are put in order by range; equal ones are counted before they move. `kept` writes a table.
    """
    keep = keep or {k: F.col(k) for k in keys}
    distinct = rows.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in counts.items()))
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(c.alias(n) for n, c in keep.items()), *counts)
    schema = T.StructType([*ordered.schema.fields, *(T.StructField(n, T.LongType()) for n in (*(f"inside_{n}" for n in counts), "part"))])

    summed, out = [*counts], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), dict.fromkeys(summed, 0)
        for batch in batches:
            inside = []
            for n in summed:
                upto = total[n] + np.cumsum(batch.column(n).to_numpy(zero_copy_only=False))
                inside.append(pa.array(upto - batch.column(n).to_numpy(zero_copy_only=False)))
                total[n] = int(upto[-1]) if len(upto) else total[n]
            yield pa.RecordBatch.from_arrays([*batch.columns, *inside, pa.array([part] * batch.num_rows, pa.int64())], out)

    placed = kept(ordered.mapInArrow(run, schema), name)
    sums = placed.groupBy("part").agg(*(F.sum(n).alias(n) for n in counts))  # one row for each task
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("part", *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"offset_{n}") for n in counts))
    before = ((F.col(f"inside_{n}") + F.col(f"offset_{n}")).alias(f"before_{n}") for n in counts)
    return placed.join(offset, "part").select(*keep, *counts, *before)


def suffix_ranks(chains: Chains, syms: DataFrame, level: int, shape: Shape, open_: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the open suffixes (id; None: all): 1 + how many open ones are less, right for all that differ within a window's bytes.

    `chains` gives the steps of a level (see `chains_of`), `syms` (id, sym) has the symbols of all places of this level: what
    lies behind an open suffix may have been settled by an earlier level. A symbol is a rank, 1 + how many
    places have a lesser one, so that finer ones fit in between.
    """
    trash: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        trash.append(cut_lineage(df, f"suffixes-{name}-{level}"))
        return trash[-1]

    to = lambda name: F.when(F.col(name) > 0, F.col("id") + F.col(name)).otherwise(-1 - F.col("id")).alias(name)
    kind = (F.floor(F.col("steps") / 3**level) % 3).cast("int").alias("kind")
    e = syms if open_ is None else syms.join(open_, "id", "left_semi")
    e = e.join(chains(level).select("id", kind, to("one"), to("two"), "reach"), "id")
    for there, s in (("one", "s1"), ("two", "s2")):
        e = e.join(syms.select(F.col("id").alias(there), F.col("sym").alias(s)), there, "left")
    e = kept(e.select("id", "kind", "one", "two", "reach", "sym", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2")), "open")

    triple = ["sym", "s1", "s2"]
    sampled = e.where("kind > 0")
    # A chain that ends behind the triple comes first.
    sampled = sampled.select("id", "reach", *triple, (F.col("reach") > 0).cast("int").alias("goes"))
    names = ranked(sampled, [*triple, "goes"], {"n": F.lit(1)}, kept, "names")
    placed = trash.pop()
    named = kept(sampled.join(names, [*triple, "goes"]).select("id", "sym", (F.col("before_n") + 1).alias("name"), "n", "reach"), "named")
    discard(placed)
    # A name that one suffix has, or that reaches over a window, settles its order; rows of one name are alike in this.
    alike = named.where((F.col("n") > 1) & (F.col("reach") > 0) & (F.col("reach") < shape.width))
    up = named.select("id", F.col("name").alias("rank"))
    if level + 1 < shape.levels and not alike.isEmpty():
        # The next symbols: settled places keep theirs, the others' names come in between.
        least = named.groupBy("sym").agg(F.min("name").alias("least"))
        finer = named.join(least, "sym").select("id", (F.col("sym") + F.col("name") - F.col("least")).alias("finer"))
        after = syms.join(chains(level).select("id", kind).where("kind > 0").select("id"), "id").join(finer, "id", "left")
        inner = suffix_ranks(chains, kept(after.select("id", F.coalesce("finer", "sym").alias("sym")), "symbols"), level + 1, shape, alike.select("id"))
        trash.append(inner)
        inside = alike.select("id", "name").join(inner, "id")
        first = inside.groupBy("name").agg(F.min("rank").alias("first"))
        more = inside.join(first, "name").select("id", (F.col("rank") - F.col("first")).alias("more"))
        up = kept(up.join(more, "id", "left").select("id", (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "up")
        discard(*trash[1:-1])
        del trash[1:-1]

    # Ranks of settled places are not known here; their symbols tell them apart from open ones. Each kind asks for those it needs.
    def behind(kind: int, **asked: str) -> DataFrame:
        out = e.where(F.col("kind") == kind)
        for r, there in asked.items():
            out = out.join(up.select(F.col("id").alias(there), F.col("rank").alias(r)), there, "left")
        known = (F.coalesce(r, F.lit(0)).alias(r) if r in asked else F.lit(0).cast("long").alias(r) for r in ("r1", "r2", "rank"))
        return out.select("id", "kind", *triple, *known)

    parts = behind(0, r1="one", r2="two").union(behind(1, r2="two", rank="id")).union(behind(2, r1="one", rank="id"))
    merged = kept(parts, "merged")
    discard(*trash[:-1])
    del trash[:-1]
    near, far = ["sym", "s1", "r1"], ["sym", "s1", "s2", "r2"]
    count = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    with_two = ranked(merged.where("kind != 1"), near, {"zero": count(0), "two": count(2)}, kept, "two")
    with_one = ranked(merged.where("kind != 2"), far, {"zero": count(0), "one": count(1)}, kept, "one")
    with_two = with_two.select(*near, F.col("before_zero").alias("a0"), F.col("before_two").alias("a2"))
    with_one = with_one.select(*far, F.col("before_zero").alias("b0"), F.col("before_one").alias("b1"))
    zeros = merged.where("kind = 0").join(with_two, near).join(with_one, far).selectExpr("id", "1 + a0 + a2 + b1 AS rank")
    ones = merged.where("kind = 1").join(with_one, far).selectExpr("id", "rank + b0 AS rank")
    twos = merged.where("kind = 2").join(with_two, near).selectExpr("id", "rank + a0 AS rank")
    out = cut_lineage(zeros.union(ones).union(twos), f"suffixes-ranks-{level}")
    discard(*trash)
    return out


MEMBER = "id long, row long, at int, low int, high int, core long, digest binary"


def members(rows: DataFrame, shape: Shape, context: bool) -> DataFrame:
    """The anchors that have windows; with `context` also what their windows cover left of them and behind their core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            a = Anchors(batch)
            low, high, core = (a.column(c) for c in ("low", "high", "core"))
            own = np.flatnonzero(high >= 0)
            low, high, core, at, text = low[own], high[own], core[own], (a.starts + a.column("at"))[own], a.data.tobytes()
            cover = zip((at - high).tolist(), (at + shape.width - low).tolist(), high.tolist())
            digest = pa.array([hashlib.md5(b"%d " % h + text[x:y]).digest() for x, y, h in cover], pa.binary())
            row = batch.column("row").to_numpy(zero_copy_only=False)[a.row[own]]
            columns = [pa.array(a.ids[own]), pa.array(row), *(pa.array(x.astype(np.int32)) for x in (a.column("at")[own], low, high)), pa.array(core), digest]
            if context:
                columns += [binaries(a.data, at - high, high), binaries(a.data, at + shape.core, shape.span - 1 - low)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = MEMBER + (", left binary, rest binary" if context else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def padded(column: pa.Array, width: int, at_end: bool) -> np.ndarray:
    """Pieces of at most `width` bytes as rows of a matrix, against its right or its left side."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(x.rjust(width, b"\0") if at_end else x.ljust(width, b"\0") for x in parts), dtype=np.uint8).reshape(len(parts), width)


def repeated_offsets(group: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, rest: np.ndarray, span: int) -> np.ndarray:
    """For each row and each distance before its anchor whether the window there occurs again: in a row of its group, or n > 1 times in its own."""
    rows = len(group)
    out = np.zeros((rows, span), dtype=bool)
    code, base = BYTE_CODES[0], BASES[0]
    inverse = U64(pow(base, -1, 1 << 64))
    base = U64(base)
    before, behind = np.zeros(rows, dtype=U64), np.zeros(rows, dtype=U64)
    for k in range(span - 1):
        behind = behind * base + code[rest[:, k]]
    for o in range(span):
        if o:  # a byte more on the left, one less behind
            before = before * base + code[left[:, span - 1 - o]]
            behind = (behind - code[rest[:, span - 1 - o]]) * inverse
        own = np.flatnonzero((low <= o) & (high >= o))
        if not len(own):
            continue
        key = mix(before[own]) + behind[own]
        order = np.lexsort((key, group[own]))
        k, g = key[order], group[own][order]
        same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
        again = np.zeros(len(own), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        out[own[order], o] = again
    inside = (np.arange(span) >= low[:, None]) & (np.arange(span) <= high[:, None])
    return out | (inside & (n > 1)[:, None])


def repeated_windows(distinct: DataFrame, shape: Shape) -> DataFrame:
    """(digest, marks): which distances before the anchor begin a repeated window, as bits.

    `distinct` has digest, rank, n, low, high, core, left and rest. Rows come by core and in the
    order of ranks; neighbours with equal cores make a class.
    """
    span = shape.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(batch: pa.Table) -> pa.RecordBatch:
            core, n, low, high = (batch.column(c).to_numpy() for c in ("core", "n", "low", "high"))
            group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
            left, rest = padded(batch.column("left"), max(1, span - 1), True), padded(batch.column("rest"), max(1, span - 1), False)
            marks = repeated_offsets(group, n, low, high, left, rest, span)
            some = np.flatnonzero(marks.any(axis=1))
            bits = [x.tobytes() for x in np.packbits(marks[some], axis=1, bitorder="little")]
            return pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(some)).combine_chunks().cast(pa.binary()), pa.array(bits, pa.binary())], ["digest", "marks"])

        for whole in batches:
            for batch in slices(whole):
                held.append(batch)
                if sum(b.num_rows for b in held) < CLASS_ROWS:
                    continue
                table = pa.Table.from_batches(held)
                core = table.column("core").to_numpy()
                last = np.flatnonzero(core[1:] != core[:-1])
                if len(last):  # the last class may go on
                    yield settled(table.slice(0, int(last[-1]) + 1))
                    held = table.slice(int(last[-1]) + 1).combine_chunks().to_batches()
        if held:
            yield settled(pa.Table.from_batches(held))

    return distinct.repartition("core").sortWithinPartitions("rank").mapInArrow(run, "digest binary, marks binary")


def spans(found: DataFrame, span: int) -> DataFrame:
    """(row, first, count): runs of windows, from `found` (row, at, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            marks = np.unpackbits(padded(batch.column("marks"), -(-span // 8), False), axis=1, bitorder="little", count=span)
            edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (own, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            at, row = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("at", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at - (end - 1)), pa.array(end - begin)], ["row", "first", "count"])

    return found.mapInArrow(run, "row long, first long, count long")


def repeated_spans(rows: DataFrame, shape: Shape) -> DataFrame | None:
    """(row, first, count) of all runs of repeated windows that `rows` (what `marked` gives) has not settled, or None if no row has an anchor."""
    held = rows.where("at IS NOT NULL")
    if held.isEmpty():
        return None
    trash: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        trash.append(cut_lineage(df, f"suffixes-{name}"))
        return trash[-1]

    names = ranked(symbols(held, shape, True), ["symbol"], {"n": F.lit(1)}, kept, "alphabet", {"digest": F.unhex(F.md5("symbol"))})
    start = symbols(held, shape, False).join(names.selectExpr("digest", "before_n + 1 AS sym"), "digest").select("id", "sym")
    ranks = suffix_ranks(chains_of(held), kept(start, "start"), 0, shape)
    discard(*trash)

    first = (F.first(c).alias(c) for c in ("low", "high", "core", "left", "rest"))
    parts = held.select("row", "base", "text", "at", "low", "high", "core")
    distinct = members(parts, shape, True).groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *first).join(ranks, "id")
    marks = cut_lineage(repeated_windows(distinct.drop("id"), shape), "suffixes-marks")
    each = members(parts, shape, False).select("row", "at", "digest")
    found = cut_lineage(spans(each.join(marks, "digest").select("row", "at", "marks"), shape.span), "suffixes-spans")
    discard(ranks, marks)
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, texts: bool = True) -> DataFrame:
    """Per document its id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes; only with `texts`)."""
    shape = Shape(width)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = marked(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), shape, texts)
    found = repeated_spans(rows, shape)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            n_removed, n_spans, digests, kept = [], [], batch.column("sha256").to_pylist(), []
            for k in range(batch.num_rows):
                first, count = ([x for c in cs for x in batch.column(c)[k].as_py() or ()] for cs in (("known", "first"), ("many", "count")))
                text = batch.column("text")[k].as_py()
                removed = runs = 0
                if first:
                    gone = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.array(first) + np.array(count) + width - 1, -1)
                    out = np.cumsum(gone[:-1]) > 0
                    removed, runs = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    text = np.frombuffer(text, dtype=np.uint8)[~out].tobytes()
                    digests[k] = hashlib.sha256(text).hexdigest()
                n_removed.append(removed)
                n_spans.append(runs)
                kept.append(text)
            columns = [batch.column("id"), batch.column("n_bytes"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if texts else [])], names)

    none = F.lit(None).cast("array<long>")
    own = ["id", "n_bytes", "sha256", "text", "known", "many"]
    if found is None:
        return rows.select(*own, none.alias("first"), none.alias("count")).mapInArrow(cut, schema)
    plain = rows.where("at IS NULL").select(*own, none.alias("first"), none.alias("count"))
    per_row = found.groupBy("row").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    open_ = rows.where("at IS NOT NULL").select("row", *own).join(per_row, "row", "left")
    open_ = open_.select(*own, F.col("runs.first").alias("first"), F.col("runs.count").alias("count"))
    return plain.union(open_).mapInArrow(cut, schema)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT line, {WIDTH} * c AS first, substr(h, {2 * WIDTH} * c + 1, {4 * WIDTH - 2}) AS part FROM d, range(0, length(h) // {2 * WIDTH} + 1) t(c)),
w AS (SELECT line, first + p AS p, hash(substr(part, 2 * p + 1, {2 * WIDTH})) AS k FROM c, range(0, {WIDTH}) t(p) WHERE 2 * p + {2 * WIDTH} <= length(part)),
r AS (SELECT line, p FROM (SELECT line, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
e AS (SELECT line, p, coalesce(p > lag(p) OVER o + {WIDTH}, true) AS new FROM r WINDOW o AS (PARTITION BY line ORDER BY p)),
g AS (SELECT line, p, sum(new::INT) OVER (PARTITION BY line ORDER BY p) AS run FROM e),
s AS (SELECT line, run, min(p) AS a, max(p) + {WIDTH} AS b FROM g GROUP BY line, run),
cut AS (SELECT line, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY line),
kept AS (
    SELECT d.line, array_to_string(list_transform(range(0, len(a) + 1),
        lambda i: substr(h, (CASE WHEN i = 0 THEN 0 ELSE 2 * b[i] END) + 1, (CASE WHEN i = len(a) THEN length(h) ELSE 2 * a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE 2 * b[i] END))), '') AS h
    FROM d JOIN cut USING (line))
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut USING (line) LEFT JOIN kept USING (line)
"""


@register("op13_suffixes", SQL)
def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
