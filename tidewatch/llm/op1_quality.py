"""Quality rules by suffix-array repetition.

The suffix array of a document's words, built by prefix doubling, puts equal word runs next
to each other. Neighbours' longest common prefixes form intervals; the deepest interval that
holds a suffix gives the longest repeated run that begins there. Runs that a run one word
earlier extends are not maximal and are left out. The spans of the maximal runs are united,
and two figures are limited: the share of words inside long repeats, and the longest repeat.

Documents are independent, so this is one narrow pass; no row leaves its partition.
Nulls and empty texts have no words and fail the base rule. Repeated rows and null ids give
one result row each. Texts of any length are read whole, one longer than a block as a block of its
own. An empty table gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import BYTE_CODES, SPACE, U64, Block, blocks, mix, span_hashes

WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A repeat counts from this many words on; its words may be this percentage of the document.
MIN_RUN = 10
MAX_COVERED_PERCENT = 30
#: No repeat may be longer than this.
MAX_LONGEST = 60

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_array(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the token runs tokens[i:ends[i]], and each neighbour pair's common prefix.

    Prefix doubling: a rank is the place of the first suffix with the same 2^l tokens. Only
    suffixes that still share their rank are sorted again. The ranks of all levels give the
    common prefixes by descending powers of two. Tokens of different documents must differ.
    """
    n = len(tokens)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    tied = np.flatnonzero(counts[inverse] > 1)
    levels, width = [rank], 1
    while len(tied):
        after = tied + width
        inside = after < ends[tied]
        follow = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[tied] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        group = rank[tied]
        place = np.arange(len(tied))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first_of_group = np.maximum.accumulate(np.where(new_group, place, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, place, 0))
        rank = rank.copy()
        rank[tied] = group + first_of_key - first_of_group
        size = np.diff(np.append(np.flatnonzero(new_key), len(tied)))
        tied = np.sort(tied[np.repeat(size, size) > 1])
        levels.append(rank)
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    pairs = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]]) if n > 1 else common
    a, b, length = order[pairs], order[pairs + 1], np.zeros(len(pairs), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[level][np.where(inside, x, 0)] == levels[level][np.where(inside, y, 0)])
        length += same * (1 << level)
    common[pairs] = length
    return order, common


def repeats(block: Block) -> np.ndarray:
    """Length of the longest repeated run that begins at each word (0: none)."""
    words = block.word_hashes()
    longest = np.zeros(len(words), dtype=np.int64)
    if len(words):
        tokens = mix(words ^ mix(block.doc.astype(U64) + U64(1)))
        order, common = suffix_array(tokens, np.repeat(block.bounds[1:], np.diff(block.bounds)))
        deepest = np.maximum(np.append(0, common), np.append(common, 0))
        longest[order] = deepest
    return longest


def maximal(block: Block, longest: np.ndarray, least: int) -> np.ndarray:
    """Begins of the repeated runs of at least `least` words that no run one word earlier extends."""
    inner = np.zeros(len(longest), dtype=bool)
    inner[1:] = (longest[:-1] == longest[1:] + 1) & (block.doc[:-1] == block.doc[1:])
    return np.flatnonzero((longest >= least) & ~inner)


def duplicate_lines(block: Block) -> np.ndarray:
    """For each document, its lines with a word that equal an earlier line."""
    starts, ends, doc = block.lines()
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    lines = span_hashes(BYTE_CODES[0][block.data], starts, ends)
    _, first = np.unique(mix(lines ^ mix(doc.astype(U64) + U64(1))), return_index=True)
    count = lambda d: np.bincount(d, minlength=block.rows)
    return count(doc) - count(doc[first])


def measure(block: Block, min_run: int = MIN_RUN) -> dict[str, np.ndarray]:
    """Counts of every document of a block."""
    n_words = np.diff(block.bounds)
    points = (block.data & 0xC0) != 0x80
    longest = repeats(block)
    runs = maximal(block, longest, min_run)
    windows = np.flatnonzero(longest >= WINDOW)
    most = np.zeros(block.rows, dtype=np.int64)
    np.maximum.at(most, block.doc, longest)
    return {
        "n_words": n_words,
        "word_chars": block.per_doc_bytes(points & ~SPACE[block.data]),
        "n_symbols": block.per_doc_bytes(SYMBOL[block.data]),
        "n_dup_lines": duplicate_lines(block),
        "n_repeat_words": block.per_doc(block.covered(windows, WINDOW)),
        "covered_words": block.per_doc(block.covered(runs, longest[runs])),
        "longest_repeat": most,
    }


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_run: int = MIN_RUN,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """One row per document with its counts, `base_failed` and `kept`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(b, min_run) for b in blocks(batch, "text")]
            if not parts:
                continue
            got = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}
            n = got["n_words"]
            failed = (n < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            bad = (100 * got["covered_words"] > max_covered_percent * n) | (got["longest_repeat"] > max_longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, got.values()), pa.array(failed), pa.array(~failed & ~bad)],
                [id_col, *got, "base_failed", "kept"],
            )

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(
        run, f"`{id_col}` {kind}, {counts}, base_failed boolean, kept boolean"
    )


def window_sql(width: int) -> str:
    """Words inside runs of `width` words that a document holds twice or more, per document."""
    return f"""
        SELECT doc_id, count(DISTINCT p + j) AS n FROM (
            SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS times
            FROM (SELECT doc_id, p, list_slice(words, p, p + {width - 1}) AS w
                  FROM words, range(1, len(words) - {width - 2}) t(p) WHERE len(words) >= {width}))
        , range({width}) u(j) WHERE times > 1 GROUP BY doc_id"""


SQL = rf"""
WITH words AS (
    SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
short AS ({window_sql(WINDOW)}),
runs AS ({window_sql(MIN_RUN)}),
long AS (
    SELECT doc_id, max(length) AS longest FROM (
        SELECT DISTINCT doc_id, {MAX_LONGEST + 1} AS length FROM words, range(1, len(words) - {MAX_LONGEST - 1}) t(p)
        WHERE len(words) > {MAX_LONGEST}
        GROUP BY doc_id, list_slice(words, p, p + {MAX_LONGEST}) HAVING count(*) > 1)
    GROUP BY doc_id),
counts AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(short.n, 0)::BIGINT AS n_repeat_words,
        coalesce(runs.n, 0)::BIGINT AS covered_words, long.doc_id IS NOT NULL AS too_long
    FROM words w LEFT JOIN lines USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN runs USING (doc_id)
    LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, too_long,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
         OR 100 * covered_words > {MAX_COVERED_PERCENT} * n_words OR too_long) AS kept
FROM counts
"""


@register("op1_quality", SQL)
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.selectExpr("* EXCEPT (longest_repeat)", f"longest_repeat > {MAX_LONGEST} AS too_long")
