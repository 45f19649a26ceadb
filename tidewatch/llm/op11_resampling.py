"""Importance resampling of documents towards the word statistics of target texts.

Words are runs of ASCII letters and digits and of any character above U+007F; A to Z are taken as
a to z, nothing else is folded. Features are all runs of 1 to `ngrams` consecutive words, joined
by one space, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo `buckets`.

1. Every task counts the buckets of its rows; the counts are added up per bucket, for the
   documents and for the target texts.
2. A bucket's gain is the logarithm of how much more often the target has it (counts start at
   one). The gains are one number per bucket, whatever the corpus, and go to every task.
3. A second pass adds up each document's gains. With a noise that depends on seed and id alone,
   the highest scores are a draw without replacement in proportion to the weights.
4. The drawn share is ranked: scores are counted per slice of their range, only the slice in
   which the draw ends is cut, and rows are numbered inside slices.

CRCs are computed by length: the distinct features of a block that have equal length make one
matrix of bytes, and all CRCs of the matrix go forward one column at a time. Features longer than
LONG bytes are rare and few of one length; each is one call of zlib.

Null texts have no words; texts of any length are read whole. A null id counts as the empty
string in the noise and comes after all others among equal scores. Repeated rows are separate
rows with equal scores and ranks of their own. An empty target gives a gain that depends on the
documents alone; an empty table gives no rows. Of other columns only those asked for are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import U64, Block, batches_of, ragged, span_hashes
from tidewatch.session import cut_lineage

NGRAMS, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Features of more bytes are hashed one by one.
LONG = 64
#: Rows of scores that are put in order by one task.
SLICE_ROWS = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes between words: all of ASCII but letters and digits.
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def crc_steps() -> np.ndarray:
    """What one byte does to a CRC-32 (the reflected polynomial of zlib), for every byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    return step


STEPS = crc_steps()


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows at once, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = STEPS[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def distinct_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct rows, for each row its place among them); the hashes only save time."""
    _, first, each = np.unique(hashes, return_index=True, return_inverse=True)
    if not (rows == rows[first[each]]).all():  # two features with one hash
        _, first, each = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, each.reshape(-1)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, computed once for each distinct string."""
    out = np.empty(len(starts), dtype=np.uint32)
    size = ends - starts
    hashes = span_hashes(data.astype(U64) + U64(1), starts, ends)
    order = np.argsort(size, kind="stable")
    lengths, cut = np.unique(size[order], return_index=True)
    for length, group in zip(lengths.tolist(), np.split(order, cut[1:])):
        if length > LONG:
            out[group] = [zlib.crc32(data[starts[k] : ends[k]]) for k in group]
            continue
        rows = data[starts[group][:, None] + np.arange(length)]
        first, each = distinct_rows(rows, hashes[group])
        out[group] = crc_columns(rows[first])[each]
    return out


def joined(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block with one space after each, and where each begins and ends."""
    size = block.ends - block.starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    out[ragged(ends - size, size)] = LOWER[block.data[ragged(block.starts, size)]]
    return out, ends - size, ends


def feature_buckets(block: Block, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of a block."""
    data, starts, ends = joined(block)
    found, doc = [], []
    for n in range(1, ngrams + 1):
        at = block.windows(n)
        found.append(span_crcs(data, starts[at], ends[at + n - 1]) % np.uint32(buckets))
        doc.append(block.doc[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(doc)


def word_blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[Block]:
    for first, _, data, offsets in batches_of(batch, column):
        yield Block(first, data, offsets, BETWEEN)
    pa.default_memory_pool().release_unused()


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of `texts` (text); each task sends a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in word_blocks(batch):
                n += np.bincount(feature_buckets(block, ngrams, buckets)[0], minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, targets: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 * log of its share in the target over that in the documents).

    Both have a column text. One number per bucket comes to the driver.
    """
    counts = []
    for texts in (documents, targets):
        n = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(texts, ngrams, buckets).collect():
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    all_s, all_t = int(s.sum()), int(t.sum())
    up, down = float(all_s + buckets), float(all_t + buckets)
    return np.array([math.floor(1000 * math.log((a + 1) * up / ((b + 1) * down))) for a, b in zip(t.tolist(), s.tolist())], dtype=np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, ngrams: int, keep: list[Column]) -> DataFrame:
    """The kept columns, n_words, n_features and weight (the sum of the features' gains) of every row of `documents` (text)."""
    given = documents.select(*keep, "text")
    out = documents.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    known = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for block in word_blocks(batch):
                bucket, doc = feature_buckets(block, ngrams, len(gain))
                order = np.argsort(doc, kind="stable")
                run = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                cut = np.searchsorted(doc[order], np.arange(block.rows + 1))
                rows = slice(block.first, block.first + block.rows)
                n_words[rows], n_features[rows], weight[rows] = np.diff(block.bounds), np.diff(cut), np.diff(run[cut])
            kept = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_words, n_features, weight))], out.names)

    return given.mapInArrow(run, out)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngrams: int = NGRAMS,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, keep: list[Column] | None = None,
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    floor(percent * N / 100) of the N documents with `least_words` words or more are drawn, the
    highest scores first, ties to the smaller id. `keep` names further columns to carry along.
    """
    own = [F.col(f"`{id_col}`").alias("id"), *([F.struct(*keep).alias("row")] if keep else [])]
    texts = documents.select(*own, F.col(f"`{text_col}`").cast("string").alias("text"))
    gain = gains(texts, targets.select(F.col(f"`{target_col}`").cast("string").alias("text")), ngrams, buckets)
    names = ["id", *(["row"] if keep else [])]
    score = F.col("weight") + noise(F.col("id"), seed)
    # A number of its own for each row, so that repeated rows get ranks of their own; fixed once written.
    scored = weighed(texts, gain, ngrams, [F.col(c) for c in names]).withColumn("score", score).withColumn("line", F.monotonically_increasing_id())
    scored = cut_lineage(scored, "resampling-scores")
    return drawn(scored, (F.col("n_words") >= least_words), percent).select(F.col("id").alias(id_col), *names[1:], "n_words", "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, able: Column, percent: int) -> DataFrame:
    """All rows of `scored` (id, score, line, ...) with rank: 1, 2, ... in order for the drawn ones, else null.

    Rows are put in order by range, so that no task sorts more than a slice. What a slice needs
    from those before it is one count.
    """
    n = scored.where(able).count()
    many = n * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("line")]
    parts = max(1, -(-n // SLICE_ROWS))
    placed = scored.where(able).repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id())
    placed = cut_lineage(placed, "resampling-slices")
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # one row for each slice
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.select("slice", before.alias("before")).where(F.col("before") < many)
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    ranked = placed.join(wanted, "slice").withColumn("rank", F.col("before") + inside)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank"))).select(*scored.columns, "rank")
    undrawn = placed.join(wanted, "slice", "left_anti").select(*scored.columns).union(scored.where(~able))
    return ranked.union(undrawn.withColumn("rank", F.lit(None).cast("long")))


SQL = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS line FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
used AS (SELECT line, unnest(w) AS f FROM words),
step AS (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) t(i)),
steps AS (SELECT list(v ORDER BY i) AS tab FROM step),
coded AS (
    SELECT f, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, octet_length(encode(f)) + 1), lambda k: ('0x' || substr(hex(encode(f)), (2 * k - 1)::BIGINT, 2))::UBIGINT),
        lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295) % {BUCKETS} AS b
    FROM (SELECT DISTINCT f FROM (SELECT f FROM used UNION ALL SELECT f FROM target)), steps),
s AS (SELECT b, count(*) AS n FROM used JOIN coded USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN coded USING (f) GROUP BY b),
gain AS (
    SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + {BUCKETS})::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS g
    FROM s FULL JOIN t USING (b)),
weights AS (SELECT line, sum(g) AS weight FROM used JOIN coded USING (f) JOIN gain USING (b) GROUP BY line),
scored AS (
    SELECT doc_id, line, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weights USING (line)),
able AS (SELECT line, row_number() OVER (ORDER BY score DESC, doc_id, line) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN able USING (line)
"""


@register("op11_resampling", SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    out = resample(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
