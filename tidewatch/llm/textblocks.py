"""Whole texts of an Arrow batch as flat numpy arrays: words, lines and their hashes.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. Null texts
count as empty. A batch is cut into blocks of whole documents of about BLOCK_BYTES, so that
the arrays stay small whatever the batch size; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
#: Rows of a batch that are copied or turned into Python values at a time.
SLICE_ROWS = 512

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = 0x0A


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's finaliser)."""
    x = np.atleast_1d(np.asarray(x, dtype=U64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd multipliers of the polynomial hashes, one for each independent lane.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BYTE_CODES = [mix(np.arange(1, 257, dtype=U64) + U64(lane << 32)) for lane in range(len(BASES))]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for blocks of the usual size."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        run = np.full(max(n, 1024), base, dtype=U64)
        run[0] = 1
        known = np.cumprod(run, dtype=U64)
        if n <= 8 * BLOCK_BYTES:
            _powers[base] = known
    return known[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of codes[start:end] for each span, whatever its place."""
    base = BASES[lane]
    inverse = pow(base, -1, 1 << 64)
    run = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * powers(base, len(codes)), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(inverse, len(codes) + 1)[starts] + (ends - starts).astype(U64))


def batches_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block of whole texts."""
    for base in range(0, batch.num_rows, SLICE_ROWS):
        texts = pc.fill_null(batch.column(column).slice(base, SLICE_ROWS), "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
            end = min(end, n)
            yield base + row, base + end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


@dataclass
class Block:
    """Some whole documents: their bytes one after another, document k at data[offsets[k]:offsets[k + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    space: np.ndarray = field(default_factory=lambda: SPACE)  # bytes between words

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.space[self.data]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        begins[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(begins), np.flatnonzero(closes) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def bounds(self) -> np.ndarray:
        """Document k has the words bounds[k] to bounds[k + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def word_hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(BYTE_CODES[lane][self.data], self.starts, self.ends, lane)

    def window_hashes(self, words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
        """A hash of each run of `width` words; runs that pass a document's end are meaningless."""
        first = np.arange(max(0, len(words) - width + 1))
        return span_hashes(words, first, first + width, lane)

    def windows(self, width: int) -> np.ndarray:
        """Places of the runs of `width` words that stay inside their document."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))
        return np.flatnonzero(left >= width)

    def covered(self, at: np.ndarray, length) -> np.ndarray:
        """Whether each word lies in one of the runs of `length` words that begin at `at`."""
        edge = np.zeros(len(self.starts) + 1, dtype=np.int64)
        edge += np.bincount(at, minlength=len(edge))
        edge -= np.bincount(at + length, minlength=len(edge))
        return np.cumsum(edge[:-1]) > 0

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document of a number per word."""
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def per_doc_bytes(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document of a number per byte."""
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every line; lines are what lies between newlines."""
        breaks = np.flatnonzero(self.data == NEWLINE)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        doc = np.concatenate([np.arange(self.rows), np.searchsorted(self.offsets, breaks, side="right") - 1])
        end_doc = np.concatenate([doc[self.rows :], doc[: self.rows]])
        by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, end_doc))
        return starts[by_start], ends[by_end], doc[by_start]


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[Block]:
    for first, _, data, offsets in batches_of(batch, column):
        yield Block(first, data, offsets)
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that what is made of them stays small."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of every piece, one piece after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
