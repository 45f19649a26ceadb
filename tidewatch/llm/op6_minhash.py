"""Near duplicates by DartMinHash signatures and a banded join.

An element of weight w owns the region [0, w) x [0, rank): darts, a Poisson process of rate one
drawn from the element's hash, fall into it, the same for every document. Each dart has a random
coordinate of the signature, which keeps the dart of least rank; two documents agree at a
coordinate with the probability of their weighted Jaccard similarity. Only darts below a rank
that leaves about K ln K + 2 K of them are thrown, so a signature costs one draw per element and
a few darts per coordinate, not K hashes per element. Documents with an empty coordinate throw
again, twice as far.

Elements are the distinct runs of five words (a shorter text is one run), with weight 1 or with
their number of occurrences. Bands of the signature bring documents together; pairs are then
compared exactly, and documents whose similarity reaches the threshold form connected groups.
Texts with the same words are one before anything is compared. At similarity 0.8 a pair is missed
by all 32 bands of 4 rows with probability 5e-8.

Null texts count as empty; texts without words are copies of each other. A null id takes no part
and gets a null class; rows with one id share a class. Texts of any length are read whole. An
empty table gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.linking import linked, shared_members
from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import U64, Block, blocks, mix, ragged, span_hashes
from tidewatch.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 4
#: Rank intervals: up to 1 / 2 ** FINE, doubling up to 1, then of length 1 (in units of the weight slab's width).
FINE = 4


def elements(block: Block, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of a block: distinct runs of SHINGLE words, by document."""
    words = block.word_hashes()
    at = block.windows(SHINGLE)
    doc, shingle = block.doc[at], block.window_hashes(words, SHINGLE)[at] if len(at) else np.empty(0, dtype=U64)
    n = np.diff(block.bounds)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = span_hashes(words, block.bounds[short], block.bounds[short + 1])
    doc, shingle = np.concatenate([doc, short]), np.concatenate([shingle, whole])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]) if len(doc) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    return doc[first], shingle[first], (times if counted else np.ones_like(times)).astype(np.float64)


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1)."""
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, rank, hash) of all darts in the regions [0, weight) x [0, rank)."""
    # Weight slabs [0, 1), [1, 2), [2, 4), [4, 8), ...
    slabs = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    owner = np.repeat(np.arange(len(element)), slabs)
    slab = ragged(np.zeros(len(slabs), dtype=np.int64), slabs)
    width = np.where(slab == 0, 1.0, 2.0 ** np.maximum(slab - 1, 0))
    low = np.where(slab == 0, 0.0, width)
    # Rank intervals, in units in which a slab has width 1.
    reach = rank[owner] * width
    cells = np.where(
        reach <= 1, 1 + np.maximum(0, np.ceil(np.log2(np.maximum(reach, 1e-300)) + FINE)), FINE + 1 + np.ceil(np.maximum(reach - 1, 0))
    ).astype(np.int64)
    which = np.repeat(np.arange(len(owner)), cells)
    cell = ragged(np.zeros(len(cells), dtype=np.int64), cells)
    seed = mix(element[owner[which]] ^ mix((slab[which].astype(U64) << U64(40)) + cell.astype(U64) + U64(1)))
    area = np.where(cell == 0, 2.0**-FINE, np.where(cell <= FINE, 2.0 ** (np.minimum(cell, FINE) - 1 - FINE), 1.0))
    start = np.where(cell == 0, 0.0, np.where(cell <= FINE, area, cell - FINE))
    # As many darts as a Poisson variable with the cell's area as mean.
    draw = unit(mix(seed + U64(0x2545F4914F6CDD1D)))
    term = np.exp(-area)
    hit = np.flatnonzero(draw >= term)
    count, total = np.zeros(len(hit), dtype=np.int64), term[hit]
    term, more = total.copy(), np.ones(len(hit), dtype=bool)
    while more.any():
        count += more
        term = term * area[hit] / np.maximum(count, 1)
        total = total + np.where(more, term, 0)
        more &= (draw[hit] >= total) & (term > 1e-18)
    dart = np.repeat(hit, count)
    h = mix(seed[dart] + U64(0x9E3779B97F4A7C15) * (ragged(np.ones(len(count), dtype=np.int64), count)).astype(U64))
    own = which[dart]
    height = low[own] + width[own] * unit(mix(h + U64(1)))
    at = (start[dart] + area[dart] * unit(mix(h + U64(2)))) / width[own]
    inside = (height < weight[owner[own]]) & (at < rank[owner[own]])
    return owner[own][inside], at[inside], h[inside]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """A signature of k dart hashes for each of n documents; documents without elements get zeros."""
    out = np.zeros((n, k), dtype=U64)
    total = np.bincount(doc, weights=weight, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        own, at, h = darts(element[mine], weight[mine], reach[doc[mine]])
        own = doc[mine][own]
        coordinate = (mix(h + U64(3)) % U64(k)).astype(np.int64)
        place = own * k + coordinate
        nearest = np.full(n * k, -1)
        by_rank = np.argsort(-at)
        nearest[place[by_rank]] = by_rank  # the last one written to a place stays
        found = (nearest.reshape(n, k) >= 0).sum(axis=1)
        full = todo & (found == k)
        out[full] = h[nearest.reshape(n, k)[full]]
        todo &= ~full
        reach = reach * 2
    return out


def bands(signature: np.ndarray, count: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each band of each signature, different in different bands."""
    key = np.zeros((len(signature), count), dtype=U64) + mix(np.arange(1, count + 1, dtype=U64))
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :count])
    return key


def sketches(docs: DataFrame, counted: bool = False, n_bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, words1, words2, bands): a 128-bit hash of the words and the band keys, none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                sig = signatures(*elements(block, counted), block.rows, n_bands * rows)
                keys = bands(sig, n_bands, rows).view(np.int64)
                full = np.diff(block.bounds) > 0
                offsets = np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)
                hashes = [span_hashes(block.word_hashes(lane), block.bounds[:-1], block.bounds[1:], lane).view(np.int64) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(block.first, block.rows), *map(pa.array, hashes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1))),
                    ],
                    ["id", "words1", "words2", "bands"],
                )

    return docs.mapInArrow(run, "id long, words1 long, words2 long, bands array<long>")


def element_lists(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(id, elements): the elements as numbers, one for each unit of weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                doc, element, weight = elements(block, counted)
                copies = weight.astype(np.int64)
                each = mix(np.repeat(element, copies) + ragged(np.zeros(len(copies), dtype=np.int64), copies).astype(U64))
                size = np.bincount(doc, weights=copies, minlength=block.rows).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(each.view(np.int64)))],
                    ["id", "elements"],
                )

    return docs.mapInArrow(run, "id long, elements array<long>")


def prefix_pairs(lists: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different labels that can reach the similarity; `lists` has id and elements.

    Under one order of all elements, rare ones first, two such sets share one of their first
    n - ceil(similarity * n) + 1 elements. At the first one they share, what follows it in either
    must suffice for the rest of the overlap. A passage that many documents hold comes last in
    each, and a copy with too many changes of its own has used up its places by then, so neither
    brings documents together.
    """
    each = lists.select("id", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    times = cut_lineage(each.groupBy("element").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "minhash-times")
    # Elements of one document only come first and can't be shared: they just use up places.
    common = each.join(times, "element").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("by_times"))
    own = F.col("n") - F.size("by_times")
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - own
    prefix = common.where(first > 0).select("id", "n", own.alias("own"), F.posexplode(F.slice("by_times", F.lit(1), first.cast("int"))).alias("at", "e"))
    after = (F.col("n") - F.col("own") - F.col("at")).alias("after")
    prefix = cut_lineage(prefix.join(labels, "id").select("id", "n", "label", after, F.col("e.element").alias("element")), "minhash-prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    fits = (F.col("x.n") >= similarity * F.col("y.n") - 1e-9) & (F.col("y.n") >= similarity * F.col("x.n") - 1e-9)
    fits &= F.least("x.after", "y.after") >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    pairs = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.label") < F.col("y.label")) & fits)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, counted: bool = False,
    n_bands: int = BANDS, rows: int = BAND_ROWS,
) -> DataFrame:
    """(id, class_id) of every row; class_id is the least id of the connected group."""
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = given.where("id IS NOT NULL")
    sketched = cut_lineage(sketches(known, counted, n_bands, rows), "minhash-sketches")
    # Texts with the same words are one; the least id stands for them. Rows with one id stand together.
    same = cut_lineage(sketched.groupBy("words1", "words2").agg(F.min("id").alias("rep")), "minhash-same")
    held = sketched.join(same, (F.col("id") == F.col("rep")) & (sketched.words1 == same.words1) & (sketched.words2 == same.words2))
    members = shared_members(cut_lineage(held.select("id", F.col("bands").alias("keys")), "minhash-bands"), n_bands, "minhash")

    def lists_of(ids: DataFrame, step: str) -> DataFrame:
        ids = cut_lineage(ids.distinct(), f"minhash-ids-{step}")
        return cut_lineage(element_lists(known.join(ids, "id", "left_semi"), counted), f"minhash-elements-{step}")

    def verify(pairs: DataFrame) -> DataFrame:
        lists = lists_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "pairs")
        left, right = lists.select(F.col("id").alias("a"), F.col("elements").alias("x")), lists.select(F.col("id").alias("b"), F.col("elements").alias("y"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common * (1 + similarity) >= similarity * (F.size("x") + F.size("y")) - 1e-9)

    def across(open_: DataFrame) -> DataFrame:
        return prefix_pairs(lists_of(open_.select("id"), "open"), open_.select("id", "label").distinct(), similarity)

    labels = linked(members, verify, across, "minhash")
    found = same.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("words1", "words2", F.coalesce("label", "rep").alias("class_id"))
    s, f = sketched.alias("s"), found.alias("f")
    classed = s.join(f, (F.col("s.words1") == F.col("f.words1")) & (F.col("s.words2") == F.col("f.words2")))
    classed = classed.select(F.col("s.id").alias(id_col), "class_id")
    alone = given.where("id IS NULL").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return classed.union(alone)


@register("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
