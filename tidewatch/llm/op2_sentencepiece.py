"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words stand in one flat array. A round finds, for each word, the least
rank among its neighbour pairs (a segmented minimum), merges every leftmost occurrence of it
at once in all words, closes the gaps, and drops the words that have no pair left. Where a
merged piece can pair up again at the same or a better rank (spaces: all runs of them share
one rank), only the word's leftmost occurrence is merged, as the sequential algorithm would.

Words are what lies before the next space marker; no piece crosses from another character
into a marker, so they are independent, and each distinct word is encoded once per task until
MAX_WORDS of them are kept. One narrow pass: no row leaves its partition.

Nulls count as empty texts, which give the begin and end ids only. Repeated rows and null ids
give one result row each. Columns other than the id and the text are ignored.
Texts of any length are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import ragged

MODEL = "piece_bpe_32k.model"
#: Distinct words that a task keeps with their ids before it starts anew.
MAX_WORDS = 200_000
#: Characters of text that are encoded at a time.
BLOCK_CHARS = 400_000

MARK = "▁"
#: Symbols that are no piece: SHIFT + code point. Symbols fit in 21 bits.
SHIFT = 1 << 20
NO_RANK = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """(left symbol, right symbol) -> (rank, merged piece), an open-addressing table in numpy."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        bits = max(4, int(4 * max(1, len(pairs))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, dtype=np.int32)
        self.pieces = np.zeros(1 << bits, dtype=np.int32)
        for key, (rank, piece) in pairs.items():
            at = int(self.slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.pieces[at] = key, rank, piece

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 21) | right
        at = self.slot(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return self.ranks[at], self.pieces[at]


class PieceCodec:
    """The encoder and decoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" Åﬁ \n b ") != f"{MARK}{MARK}Åﬁ{MARK}\n{MARK}b{MARK}":
            raise ValueError("only models that leave texts unchanged but for space markers are supported")
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)) or sp.piece_to_id("<0x00>") == sp.unk_id():
            raise ValueError("models with unused pieces or without byte fallback are not supported")
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece crosses into a space marker")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.newline_alone = not any("\n" in p and len(p) > 1 for p in ids)

        symbol = {c: SHIFT + ord(c) for p in ids for c in p} | ids
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        rank = dict(zip(scores, range(len(scores))))
        ranks = {p: rank[sp.get_score(i)] for p, i in ids.items()}
        pairs, again = {}, set()
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[(left << 21) | right] = (ranks[p], i)
                    again |= {part for part in (p[:k], p[k:]) if len(part) > 1 and ranks[part] >= ranks[p]}
        self.pairs = PairTable(pairs)
        self.one_at_a_time = np.zeros(size, dtype=bool)
        self.one_at_a_time[[ids[p] for p in again]] = True

        # Ids of a lone character: its piece, or its bytes.
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.char_piece = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_piece[ord(p)] = i
        surface = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        surface[sp.unk_id()] = sp.decode([sp.unk_id()]).encode()
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_len = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.plain = ~np.array(special)
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.word_no: dict[str, int] = defaultdict(itertools.count(0).__next__)
        self.flat = np.empty(0, dtype=np.int32)
        self.at = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each word has."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        symbols = self.char_piece[points].astype(np.int32)
        symbols = np.where(symbols < 0, (points + SHIFT).astype(np.int32), symbols)
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []

        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
        piece = np.zeros(len(symbols), dtype=np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.empty(0, dtype=np.int64)
        rank[inner], piece[inner] = self.pairs.find(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least != NO_RANK, count)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, piece = symbols[live], owner[live], rank[live], piece[live]
                count, least = count[least != NO_RANK], least[least != NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            head = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
            # Of occurrences that overlap, every second one, from the left.
            run = np.concatenate([[True], at[1:] != at[:-1] + 1]) | head
            place = np.arange(len(at))
            run_start = np.maximum.accumulate(np.where(run, place, 0))
            take = (place - run_start) % 2 == 0
            alone = self.one_at_a_time[piece[at]]
            if alone.any():
                word_start = np.maximum.accumulate(np.where(head, place, 0))
                held = np.maximum.reduceat(alone, np.flatnonzero(head))
                take &= ~np.repeat(held, np.diff(np.append(np.flatnonzero(head), len(at)))) | (place == word_start)
            at = at[take]
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), dtype=bool)
            changed[at] = True
            symbols, owner, rank, piece, changed = symbols[keep], owner[keep], rank[keep], piece[keep], changed[keep]
            changed[:-1] |= changed[1:]
            changed = np.flatnonzero(changed)
            last = (changed + 1 >= len(owner)) | (owner[np.minimum(changed + 1, len(owner) - 1)] != owner[changed])
            rank[changed[last]] = NO_RANK
            changed = changed[~last]
            rank[changed], piece[changed] = self.pairs.find(symbols[changed], symbols[changed + 1])
        if done_symbols:
            symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        return self._fall_back(symbols, owner, len(words))

    def _fall_back(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their UTF-8 bytes."""
        lone = symbols >= SHIFT
        if lone.any():
            points = symbols[lone] - SHIFT
            spelled = np.frombuffer("".join(map(chr, points.tolist())).encode(), dtype=np.uint8)
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            copies = np.ones(len(symbols), dtype=np.int64)
            copies[lone] = width
            lone = np.repeat(lone, copies)
            symbols, owner = np.repeat(symbols, copies), np.repeat(owner, copies)
            symbols[lone] = self.byte_ids[spelled]
        return symbols.astype(np.int32), np.bincount(owner, minlength=n)

    def words(self, text: str) -> list[str]:
        """The independent pieces of a text, markers in place."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.newline_alone else [text]):
            if k:
                out.append("\n")
            else:
                line = " " + line
            if "  " in line or MARK in line:
                out += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line.replace(" ", MARK))
            elif line:
                out += line.replace(" ", " " + MARK).split(" ")
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each text has; with begin and end ids."""
        if len(self.word_no) > MAX_WORDS:
            self._forget()
        before, numbers, sizes = len(self.word_no), [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                words = self.words(text)
                numbers.extend(map(self.word_no.__getitem__, words))
                sizes[k] = len(words)
        new = list(islice(self.word_no, before, None))
        if new:
            flat, length = self.merge(new)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(length) - length])
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
        numbers = np.array(numbers, dtype=np.int64)
        length = self.length[numbers]
        ids = self.flat[ragged(self.at[numbers], length)]
        run = np.concatenate([[0], np.cumsum(length)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        count = run[edge[1:]] - run[edge[:-1]]
        out = np.empty(len(ids) + 2 * len(texts), dtype=np.uint32)
        end = np.cumsum(count + 2)
        inside = np.ones(len(out), dtype=bool)
        inside[end - 1] = inside[end - count - 2] = False
        out[inside] = ids
        out[end - count - 2], out[end - 1] = self.begin, self.end
        return out, count + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, as UTF-8."""
        ids = np.asarray(ids, dtype=np.int64)
        length = self.surface_len[ids]
        flat = self.surface[ragged(self.surface_at[ids], length)].tobytes()
        run = np.concatenate([[0], np.cumsum(length)])
        out, at = [], 0
        for count in counts.tolist():
            own = ids[at : at + count]
            text = flat[run[at] : run[at + count]]
            body = own[~self.control[own]]
            # The marker before the first word isn't part of the text.
            if len(body) and self.plain[body[0]] and text[:1] == b" ":
                text = text[1:]
            try:
                text.decode()
            except UnicodeDecodeError:  # byte pieces that are no UTF-8
                text = self.library.decode(own.tolist()).encode()
            out.append(text)
            at += count
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def text_blocks(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Whole texts, nulls as empty, about `chars` characters at a time."""
    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        done = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, done + chars, side="right")))
        yield texts[row:end].to_pylist()
        row = end
    pa.default_memory_pool().release_unused()


def piece_codes(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids (little-endian unsigned 32-bit numbers in a binary) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            row = 0
            for texts in text_blocks(batch.column("text")):
                ids, counts = c.encode(texts)
                edge = np.cumsum(counts)
                packed = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(edge.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, len(texts)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(packed, pa.binary()),
                        pa.array([t.decode() for t in c.decode(ids, counts)], pa.string()),
                    ],
                    [id_col, "n_tokens", "ids", "decoded"],
                )
                row += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string"
    )


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`piece_codes` with SHA-256 digests in place of the ids and texts, which stay in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            row = 0
            for texts in text_blocks(batch.column("text")):
                ids, counts = c.encode(texts)
                edge = np.cumsum(counts)
                whole = memoryview(ids.astype("<u4").tobytes())
                coded = [sha(whole[4 * (e - n) : 4 * e]) for e, n in zip(edge.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, len(texts)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(coded, pa.string()),
                        pa.array([sha(t) for t in c.decode(ids, counts)], pa.string()),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                row += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
