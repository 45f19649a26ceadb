"""Token ids in files of fixed-width packed bits.

Documents are dealt to files by ranges of their id, sorted, encoded and written as they come.
A file holds

    magic, bits per id, ids per block          16 bytes, little-endian
    blocks                                     each id in `bits` bits, least bit first
    document ids, null marks, first ids        one entry per document (first ids: one more)
    block offsets                              one per block and the end
    documents, ids, blocks, footer's offset    4 numbers of 64 bits, then the magic

`bits` is the least width that holds every id of the vocabulary. A block of 1,024 ids fills
whole bytes, so any run of ids is unpacked by numpy from the few blocks that hold it.

Null texts count as empty and have the end id only. Null ids come first; rows with one id are
ordered by a hash of their text, and equal rows are all written. An empty table has no files.
Texts of any length are encoded whole. Columns other than the id and the text are ignored. A task holds one group of documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.llm.sharedfiles import each_alone, opened, written
from tidewatch.llm.textblocks import SPACE, ragged
from tidewatch.session import cut_lineage, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"TWBITS01"
HEAD, TAIL = "<8sII", "<QQQQ8s"
BLOCK_IDS = 1024
#: Ids that a reader unpacks at a time, unless one document has more.
READ_IDS = 1 << 20
#: Characters of text that are encoded at a time; distinct words that a task keeps with their ids.
BLOCK_CHARS, MAX_WORDS = 500_000, 300_000
#: Words that the library encodes as one text, and what stands between them; words that it gets in one call.
TOGETHER, MARK, CALL = 256, "\x01", 8192

#: Kinds of bytes: 0 beyond ASCII, 1 white space, then letters, digits and all others.
LETTER, DIGIT, OTHER = 2, 3, 4
KIND = np.zeros(256, dtype=np.uint8)
KIND[:0x80] = [1 if SPACE[b] else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(0x80)]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of each id, one after another, padded to whole bytes."""
    if bits % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        whole = np.zeros((count, 4), dtype=np.uint8)
        whole[:, : bits // 8] = np.frombuffer(data, dtype=np.uint8, count=count * bits // 8).reshape(count, bits // 8)
        return whole.reshape(-1).view("<u4")
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class WordEncoder:
    """The tokenizers library, with each distinct word's ids kept.

    The vocabulary drops white space before it splits, and nothing in it spans white space or
    the borders that `words` cuts at, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: each core has a task of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.word_no: dict[bytes, int] = defaultdict(count(0).__next__)
        self.flat = np.empty(0, dtype=np.uint32)
        self.at = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)

    def library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, flat, and how many each has.

        Many words go to the library as one text, with MARK between them, whose id tells them apart.
        """
        if self.mark is not None and not any(MARK in w for w in words):
            runs = [f" {MARK} ".join(words[k : k + TOGETHER]) + f" {MARK}" for k in range(0, len(words), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.batch(runs, add_special_tokens=False)])
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words):
                return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1
        each = [e.ids for e in self.batch(words, add_special_tokens=False)]
        length = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(length.sum())), length

    def words(self, texts: list[str | None]) -> list[list[bytes]]:
        """Parts of each text that the vocabulary never joins, so that few distinct ones remain.

        Besides white space these end where an ASCII letter, digit or other sign meets one of
        another kind, and after each digit; an apostrophe keeps the letters after it. ASCII letters
        are lower case unless a character follows that might compose with them. Texts that may
        name a special token are cut at white space only.
        """
        raw = [text.encode() if text else b"" for text in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        kind = KIND[data]
        left, right = kind[:-1], kind[1:]
        cut = (left > 1) & (right > 1) & ((left != right) | (left == DIGIT)) & ~((data[:-1] == ord("'")) & (right == LETTER))
        lower = data.copy()
        lower[:-1] = np.where((data[:-1] - ord("A") < 26) & (data[1:] < 0x80), data[:-1] | 0x20, data[:-1])
        at = np.flatnonzero(cut) + 1
        spaced, moved = np.insert(lower, at, 0x20).tobytes(), (offsets + np.searchsorted(at, offsets)).tolist()
        return [x.split() if b"<|" in x else spaced[a:b].split() for x, a, b in zip(raw, moved, moved[1:])]

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, each with the end id; and how many each has."""
        if len(self.word_no) > MAX_WORDS:
            self._forget()
        before, numbers = len(self.word_no), []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for k, words in enumerate(self.words(texts)):
            numbers.extend(map(self.word_no.__getitem__, words))
            sizes[k] = len(words)
        new = [w.decode() for w in islice(self.word_no, before, None)]
        if new:
            flat, length = map(np.concatenate, zip(*(self.library(new[k : k + CALL]) for k in range(0, len(new), CALL))))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(length) - length])
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
        numbers = np.array(numbers, dtype=np.int64)
        length = self.length[numbers]
        ids = self.flat[ragged(self.at[numbers], length)]
        run, edge = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(sizes)])
        counts = run[edge[1:]] - run[edge[:-1]] + 1
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        ends = np.cumsum(counts) - 1
        body = np.ones(len(out), dtype=bool)
        body[ends] = False
        out[body], out[ends] = ids, end_id
        return out, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def text_groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(size):
        done = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, done + BLOCK_CHARS, side="right")))
        yield batch.slice(row, end - row)
        row = end


def write_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; (part, path, n_docs, n_ids, bits) of each file, parts in ascending order of id."""
    folder = scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        coder = encoder(vocabulary)
        bits = max(1, (max(coder.vocabulary - 1, end_id)).bit_length())
        path = f"{folder}/part-{part:08d}.ids"
        keys, nulls, counts, offsets, at = [], [], [], [], struct.calcsize(HEAD)
        rest = np.empty(0, dtype=np.uint32)
        with written(path) as out:
            out.write(struct.pack(HEAD, MAGIC, bits, BLOCK_IDS))
            while batch is not None:
                for group in text_groups(batch):
                    ids, size = coder.encode(group.column("text").to_pylist(), end_id)
                    keys.append(pc.fill_null(group.column("id"), 0).to_numpy(zero_copy_only=False).astype("<i8"))
                    nulls.append(pc.is_null(group.column("id")).to_numpy(zero_copy_only=False).astype(np.uint8))
                    counts.append(size)
                    ids = np.concatenate([rest, ids])
                    whole = len(ids) // BLOCK_IDS * BLOCK_IDS
                    offsets.append(at + np.arange(whole // BLOCK_IDS) * (BLOCK_IDS * bits // 8))
                    out.write(pack(ids[:whole], bits))
                    at += whole * bits // 8
                    rest = ids[whole:]
                batch = next((b for b in batches if b.num_rows), None)
            if len(rest):
                offsets.append(np.array([at]))
                tail = pack(rest, bits)
                out.write(tail)
                at += len(tail)
            offsets = np.concatenate([*offsets, [at]]).astype("<i8")
            firsts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")
            for column in (np.concatenate(keys), np.concatenate(nulls), firsts, offsets):
                out.write(column.tobytes())
            out.write(struct.pack(TAIL, len(firsts) - 1, int(firsts[-1]), len(offsets) - 1, at, MAGIC))
        row = {"part": part, "path": path, "n_docs": len(firsts) - 1, "n_ids": int(firsts[-1]), "bits": bits}
        yield pa.RecordBatch.from_pylist([row], schema=files)

    files = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int64())])
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long, bits long"), "token-manifest")


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block = struct.unpack(HEAD, source.read_at(struct.calcsize(HEAD), 0))
        n_docs, self.n_ids, n_blocks, footer, again = struct.unpack(TAIL, source.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a complete token file")
        data = source.read_at(size - struct.calcsize(TAIL) - footer, footer)
        cut = np.cumsum([0, 8 * n_docs, n_docs, 8 * (n_docs + 1), 8 * (n_blocks + 1)])
        part = [np.frombuffer(data[a:b], dtype=t) for a, b, t in zip(cut, cut[1:], ("<i8", "u1", "<i8", "<i8"))]
        self.keys, self.nulls, self.firsts, self.offsets = part

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from the blocks that hold them."""
        if start >= end:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        count = min((last + 1) * self.block, self.n_ids) - first * self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        return unpack(data, count, self.bits)[start - first * self.block : end - first * self.block]

    def groups(self) -> Iterator[tuple[int, int]]:
        """Runs of documents with about READ_IDS ids."""
        at = 0
        while at < len(self.keys):
            end = max(at + 1, int(np.searchsorted(self.firsts, self.firsts[at] + READ_IDS, side="right")) - 1)
            yield at, min(end, len(self.keys))
            at = end


def read_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document its first id's place among all, its number of ids and their CRC-32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    f = TokenFile(source)
                    for a, b in f.groups():
                        raw = memoryview(f.ids(int(f.firsts[a]), int(f.firsts[b])).astype("<u4").tobytes())
                        edge = 4 * (f.firsts[a : b + 1] - f.firsts[a])
                        sums = [zlib.crc32(raw[x:y]) for x, y in zip(edge.tolist(), edge[1:].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(f.keys[a:b], mask=f.nulls[a:b].astype(bool)),
                                pa.array(row["base"] + f.firsts[a:b]),
                                pa.array(np.diff(f.firsts[a : b + 1])),
                                pa.array(sums, pa.int64()),
                            ],
                            [id_col, "start", "n_tokens", "ids_crc32"],
                        )

    return each_alone(based).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_tokenfiles")
def op4_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
