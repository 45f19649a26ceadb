"""Removal of word runs that occur in an earlier document, behind a count-min prefilter.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash among its
runs of GRAM words; equal windows have equal minimisers, so the number of documents that hold a
minimiser is never below the number that hold the window.

1. Each task counts, once per document, the minimisers of its rows in a sketch of two rows of
   cells and sends it as sparse shards, which are added up. What stays of a shard is one bit per
   cell: counted twice or more. Cells are sized to the text, CELL_LIMIT at most, so the bits that
   every task gets have a fixed bound. Collisions only ever overestimate: nothing is lost.
   Beyond the bound the filter lets more through, and the exact pass does more work.
2. A second pass keeps the windows whose minimiser is estimated to be repeated. Consecutive
   windows with one minimiser travel together, by minimiser, and are compared exactly (128 bits):
   a window that a smaller document holds is removed. A task sends a window for its least
   document only: its other holders in that batch are known to repeat it. So a window that a third of
   all documents hold reaches its group once per batch.
3. The removed runs, a few numbers per document, meet their text again by document.

Ids order documents; a null id counts as larger than any. Rows with one id are told apart by
their text and don't remove each other's words. Null texts have no words; texts of any length are read whole. An empty table gives no
rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import U64, Block, blocks, mix, ragged, slices
from tidewatch.session import cut_lineage

WINDOW = 50
GRAM = 8
#: Cells of a sketch row: the next power of two above CELLS_PER_BYTE for each byte of text, within these bounds.
CELLS_PER_BYTE = 1 / 32
CELL_LEAST, CELL_LIMIT = 1 << 20, 1 << 29
SHARD_CELLS = 1 << 18
ROWS = 2
#: Text bytes behind each group of windows that is compared at once.
BUCKET_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max


def minimisers(block: Block, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows and the minimiser of each."""
    gram = min(GRAM, width)
    at = block.windows(width)
    if not len(at):
        return at, np.empty(0, dtype=U64)
    least = block.window_hashes(words, gram)
    span, done = width - gram + 1, 1
    while done < span:  # a sliding minimum by doubling
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return at, least[at]


def per_document(block: Block, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The distinct minimisers of each document, one after another."""
    if not len(at):
        return least
    doc = block.doc[at]
    order = np.lexsort((least, doc))
    d, m = doc[order], least[order]
    return m[np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])])]


def block_keys(keys: Callable[[Block], np.ndarray]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The keys of all blocks of a batch of texts."""
    return lambda batch: np.concatenate([np.empty(0, dtype=U64), *map(keys, blocks(batch))])


def cells_of(least: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(least + U64(0x5851F42D4C957F2D) * U64(row + 1)) & U64(cells - 1)).astype(np.int64)


class Repeated:
    """The merged sketch: whether a minimiser is estimated to be in two documents or more."""

    def __init__(self, cells: int):
        self.cells = cells
        self.bits = np.zeros((ROWS, cells // 8), dtype=np.uint8)

    def __call__(self, least: np.ndarray) -> np.ndarray:
        out = np.ones(len(least), dtype=bool)
        for row in range(ROWS):
            cell = cells_of(least, row, self.cells)
            out &= (self.bits[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out


def cell_count(size: int, per_byte: float) -> int:
    """Cells of a sketch row for texts of `size` bytes."""
    return min(CELL_LIMIT, max(CELL_LEAST, 1 << int(size * per_byte).bit_length()))


def window_keys(width: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The minimisers of a batch's windows, each once a document."""
    return block_keys(lambda block: per_document(block, *minimisers(block, block.word_hashes(), width)))


def sketch(rows: DataFrame, cells: int, keys: Callable[[pa.RecordBatch], np.ndarray] | int) -> Repeated:
    """Count-min sketch of the keys of all batches of `rows`, merged from the tasks' sketches; a number stands for windows of that width."""
    shards = cells // SHARD_CELLS
    keys = window_keys(keys) if isinstance(keys, int) else keys

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = keys(batch)
            for row in range(ROWS):
                cell, times = np.unique(cells_of(least, row, cells), return_counts=True)
                cut = np.searchsorted(cell, np.arange(shards + 1) * SHARD_CELLS)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row * shards + full),
                        pa.array([(cell[cut[s] : cut[s + 1]] - s * SHARD_CELLS).astype("<u4").tobytes() for s in full.tolist()], pa.binary()),
                        pa.array([np.minimum(times[cut[s] : cut[s + 1]], 2).astype("u1").tobytes() for s in full.tolist()], pa.binary()),
                    ],
                    ["shard", "cells", "times"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count = None, np.zeros(SHARD_CELLS, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([np.packbits(count >= 2, bitorder="little").tobytes()])], ["shard", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if shard is not None:
                        yield done()
                    shard, count = row["shard"], np.zeros(SHARD_CELLS, dtype=np.uint8)
                cell = np.frombuffer(row["cells"], dtype="<u4")  # distinct within a row
                count[cell] = np.minimum(count[cell] + np.frombuffer(row["times"], dtype="u1"), 2)
        if shard is not None:
            yield done()

    merged = (
        rows.mapInArrow(partial, "shard long, cells binary, times binary")
        .repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, bits binary")
    )
    out = Repeated(cells)
    for row in merged.toLocalIterator():
        r, s = divmod(row["shard"], shards)
        out.bits[r][s * SHARD_CELLS // 8 : (s + 1) * SHARD_CELLS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def segments(doc: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Begins of the runs of consecutive windows of one document with one minimiser."""
    new = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(np.concatenate([[True], new])) if len(doc) else np.empty(0, dtype=np.int64)


def held_before(least: np.ndarray, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of entries (minimiser, window, document): whether a smaller document is there too."""
    order = np.lexsort((doc, window, least))
    m, w, d = least[order], window[order], doc[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (w[1:] != w[:-1])]) if len(m) else np.empty(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    later = np.empty(len(m), dtype=bool)
    later[order] = d > d[start]
    return later


def runs(mark: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, count) of the runs of marked entries whose owner stays and whose place goes up by one."""
    kept = np.flatnonzero(mark)
    new = np.concatenate([[True], (owner[kept][1:] != owner[kept][:-1]) | (at[kept][1:] != at[kept][:-1] + 1)]) if len(kept) else np.empty(0, dtype=bool)
    begin = np.flatnonzero(new)
    return kept[begin], np.diff(np.append(begin, len(kept)))


def settled_bucket() -> int:
    """Where a task's rows go that need no comparison: a bucket below 0, another one for each task, so that no reducer gets them all."""
    return -1 - TaskContext.get().partitionId()


ENTRY = "bucket long, least binary, doc binary, text binary, first binary, count binary, windows binary"
SPAN = "doc long, text_hash long, first long, count long"


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc, text_hash, first, count): `count` windows from word `first` on that a smaller document holds.

    `docs` has id, text and text_hash.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cell_count(size, CELLS_PER_BYTE)
    buckets = U64(max(16, 1 << (size // BUCKET_BYTES).bit_length()))
    repeated = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), cells, window_keys(width)))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        for batch in batches:
            ids = pc.fill_null(batch.column("id"), LAST).to_numpy(zero_copy_only=False)
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
            parts = []
            for block in blocks(batch):
                words = block.word_hashes()
                at, least = minimisers(block, words, width)
                keep = known(least)
                at, least = at[keep], least[keep]
                if len(at):
                    doc = block.doc[at]
                    # A second hash of the words: minimiser and window together are 128 bits.
                    window = block.window_hashes(block.word_hashes(lane=1), width, lane=1)[at]
                    parts.append((least, window, ids[block.first + doc], hashes[block.first + doc], at - block.bounds[doc]))
            if not parts:
                continue
            least, window, doc, text, at = map(np.concatenate, zip(*parts))
            later = held_before(least, window, doc)
            # What a smaller document of this batch holds is settled here.
            own = mix(doc.view(U64)) ^ text.view(U64)
            entry, count = runs(later, own, at)
            yield packed(np.array([settled_bucket()]), [(np.zeros(len(entry), dtype=U64), doc[entry], text[entry], at[entry], count, np.empty(0, dtype=U64))])
            send = np.flatnonzero(~later)
            # Repeated rows give equal entries.
            send = send[np.lexsort((at[send], own[send]))]
            again = (own[send][1:] == own[send][:-1]) & (at[send][1:] == at[send][:-1])
            send = send[np.concatenate([[True], ~again])] if len(send) else send
            least, window, doc, text, at, own = (x[send] for x in (least, window, doc, text, at, own))
            begin = segments(own, at, least)
            count = np.diff(np.append(begin, len(at)))
            bucket = (least[begin] % buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
            groups = np.split(order, cut[1:]) if len(order) else []
            rows = [
                (least[begin[g]], doc[begin[g]], text[begin[g]], at[begin[g]], count[g], window[ragged(begin[g], count[g])]) for g in groups
            ]
            if rows:
                yield packed(bucket[order][cut], rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for row in batch.to_pylist():
                parts = [np.frombuffer(row[k], dtype=t) for k, t in PACKED]
                if row["bucket"] < 0:
                    yield spans(*parts[1:5])
                    continue
                if row["bucket"] != current and held:
                    yield settled(held)
                    held = []
                current = row["bucket"]
                held.append(parts)
        if held:
            yield settled(held)

    moved = docs.mapInArrow(entries, ENTRY).repartition("bucket").sortWithinPartitions("bucket")
    return moved.mapInArrow(compare, SPAN)


PACKED = (("least", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("first", "<i4"), ("count", "<i4"), ("windows", "<u8"))



def packed(bucket: np.ndarray, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [pa.array([row[k].astype(t).tobytes() for row in rows], pa.binary()) for k, (_, t) in enumerate(PACKED)]
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), *columns], ["bucket", *(k for k, _ in PACKED)])


def spans(doc: np.ndarray, text: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (doc, text, first, count)], ["doc", "text_hash", "first", "count"]
    )


def settled(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The repeated runs among the entries of one bucket."""
    least, doc, text, first, count, window = (np.concatenate(x) for x in zip(*held))
    piece = np.repeat(np.arange(len(count)), count)
    at = ragged(first.astype(np.int64), count.astype(np.int64))
    later = held_before(least[piece], window, doc[piece])
    entry, n = runs(later, piece, at)
    own = piece[entry]
    return spans(doc[own], text[own], at[entry], n)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Per document its id, n_words, n_removed and the kept words, joined by one space."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = cut_lineage(repeated_spans(given, width), "substring-spans")
    per_doc = found.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    d, s = given.alias("d"), per_doc.alias("s")
    on = (F.coalesce(F.col("d.id"), F.lit(int(LAST))) == F.col("s.doc")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    joined = d.join(s, on, "left").select("d.id", "d.text", F.col("s.spans.first").alias("first"), F.col("s.spans.count").alias("count"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = {"n_words": [], "n_removed": [], "kept": []}
            for k in range(batch.num_rows):
                words = batch.column("text")[k].as_py().encode().split()
                n, firsts = len(words), batch.column("first")[k].as_py()
                if firsts:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(gone, firsts, 1)
                    np.add.at(gone, np.array(firsts) + np.array(batch.column("count")[k].as_py()) + width - 1, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                rows["n_words"].append(n)
                rows["n_removed"].append(n - len(words))
                rows["kept"].append(b" ".join(words).decode())
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], [id_col, *rows])

    return joined.mapInArrow(cut, f"`{id_col}` long, n_words long, n_removed long, kept string")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
    SELECT doc_id, p, md5(array_to_string(list_slice(words, p, p + {WINDOW - 1}), ' ')) AS h
    FROM d, range(1, len(words) - {WINDOW - 2}) t(p) WHERE len(words) >= {WINDOW}),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM w) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, p + j AS at FROM r, range({WINDOW}) u(j)),
kept AS (
    SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) AS text, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM d) x
    ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.at = x.at GROUP BY x.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@register("op3_substrings", SQL)
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
