"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line's normal form is its words in lower case, digits as 0, ASCII punctuation taken for blanks.
Equal normal forms are one line. Two lines are linked if their edit similarity reaches the limit,
and each connected group keeps its first occurrence, by document id and line number.

Words are dealt to CLASSES classes by their hash, and a line's SimHash has a block of 32 bits for each
class, made of that class's words alone. Replacing a word touches two blocks at most, inserting
or dropping one touches one. So, by the pigeonhole principle, lines that differ in up to
CLASSES - 2 blocks still agree in two, and lines meet by pairs of blocks that hold a fair
part of their letters (PART). Lines of less than SHORT letters meet by themselves and by what is
left without one letter, so none of their links is lost. Of those that meet, lines with allowed
lengths and SimHashes of all words at most DISTANCE of 64 bits apart, which sets hardly any pair at
the limit aside, are compared by edit distance, which alone decides. Before that, a bitmap of each line's runs of
GRAM letters sets aside pairs that differ in more bits than the allowed edits can turn; it loses no link.
Keys that one line alone holds
stay where they are: a merged sketch of all keys tells which are estimated to be shared, and never
misses one. Shares of links found are in tests/llm/test_lines_recall.py: of pairs with one or two
changed words practically all; edits scattered over more words than that are found less often.

Lines without a word are kept. Null texts have no lines and stay null; texts and lines of any length are
read whole. Ids order documents, a null id is larger than any other; rows equal in id and text are
one occurrence. An empty table gives no rows. Other columns are kept as they are, but for those
named n_lines and n_removed, which the result replaces. Lines are told apart by 64 bits of their hash:
two of N distinct lines are taken for one with probability N * N / 2 ** 65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.linking import linked, shared_members
from tidewatch.llm.op3_substrings import cell_count, sketch
from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import SPACE, U64, Block, batches_of, mix, ragged, slices, span_hashes
from tidewatch.session import cut_lineage, discard

EDIT_SIMILARITY = 0.9
#: Classes of words; the share of a line's letters, and the letters, that two blocks must hold to make a key.
CLASSES, PART, LETTERS = 6, 0.2, 8
PAIRS = [*combinations(range(CLASSES), 2)]
#: Bits of 64 in which the SimHashes of linked lines differ at most.
DISTANCE = 18
#: An edit changes at most GRAM runs of GRAM letters on either side. A line's bitmap has GRAM_BITS bits or more a letter, in all a power of two between these.
GRAM, GRAM_BITS, LEAST_BITS, MOST_BITS = 3, 6, 256, 1 << 16
#: Cells of the sketch of keys for each key; bytes of text for each cell of the filter of lines whose text is compared.
CELLS_PER_KEY, CELLS_PER_LINE = 2, 16
#: Numbers of 64 bits that a column of edit distances may take, and letters that texts must have, to be taken with others; letters of the pairs taken at once.
BAND_WORDS, BAND_LEAST, BAND_CELLS = 16, 32, 1 << 20
LAST = np.iinfo(np.int64).max
#: Lines of less letters differ by one edit at most; shorter ones than LEAST have no edit to spare.
SHORT, LEAST = 20, 9

BLANK = SPACE.copy()
BLANK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
DIGIT = np.arange(256, dtype=np.uint8)
DIGIT[ord("0") : ord("9") + 1] = ord("0")


def normal_blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The texts in lower case, digits as 0; words end at blanks and punctuation."""
    base = 0
    for part in slices(batch):
        lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(pc.fill_null(part.column("text"), "").cast(pa.large_string()))], ["text"])
        for first, _, data, offsets in batches_of(lowered, "text"):
            yield Block(base + first, DIGIT[data], offsets, BLANK)
        base += part.num_rows


def worded_lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, first word, end word) of the lines that have a word."""
    starts, ends, doc = block.lines()
    first, end = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    number = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    some = end > first
    return doc[some], number[some], first[some], end[some]


#: What stands for a line where lines meet: the SimHash of all words, a block per class and the letters of each.
NEAR = np.dtype([("whole", "<u8"), ("blocks", "<u4", CLASSES), ("letters", "<u4", CLASSES)])


def ones(spread: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers in runs that begin at `first`: how many of a run have each bit.

    Eight bits are counted in the bytes of one number, over at most 255 numbers at a time.
    """
    size = np.diff(np.append(first, len(spread)))
    pieces = -(-size // 255)
    cut = ragged(np.zeros(len(first), dtype=np.int64), pieces) * 255 + np.repeat(first, pieces)
    bytes_ = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).view(U64)
    counts = np.add.reduceat(bytes_, cut, axis=0).view(np.uint8).reshape(len(cut), 64).astype(np.int32)
    return counts if len(cut) == len(first) else np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)


def simhashes(words: np.ndarray, letters: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """NEAR of each line: each bit is the majority of that bit over the words (ties: 0). Lines don't overlap and leave no word out; `letters` are those of each word."""
    out = np.zeros(len(first), dtype=NEAR)
    if not len(first):
        return out
    spread = mix(words + U64(1))
    line = np.repeat(np.arange(len(first)), end - first)
    group = line * CLASSES + (mix(spread) % U64(CLASSES)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    held, size = group[order][begin], np.diff(np.append(begin, len(words)))
    bits = ones(spread[order], begin)
    own = np.searchsorted(held, np.arange(len(first)) * CLASSES)
    whole = 2 * np.add.reduceat(bits, own, axis=0) > (end - first)[:, None]
    out["whole"] = np.packbits(whole, axis=1).reshape(-1).view(U64)
    blocks, share = (np.zeros(len(first) * CLASSES, dtype=np.uint32) for _ in range(2))
    blocks[held] = np.packbits(2 * bits[:, :32] > size[:, None], axis=1).reshape(-1).view(np.uint32)
    share[held] = np.add.reduceat(letters[order], begin)
    out["blocks"], out["letters"] = blocks.reshape(-1, CLASSES), share.reshape(-1, CLASSES)
    return out


def block_keys(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, whether it counts) of each pair of blocks of each line."""
    share = near["letters"].astype(np.int64)
    own = mix(near["blocks"].astype(U64).reshape(-1) | (U64(1) << U64(32))).reshape(-1, CLASSES)
    salt = mix(np.arange(1, CLASSES + 1, dtype=U64))
    own = np.where(share > 0, mix((own ^ salt).reshape(-1)).reshape(-1, CLASSES), U64(0))
    i, j = (np.array(x) for x in zip(*PAIRS))
    held = share[:, i] + share[:, j]
    fair = held >= np.maximum(LETTERS, PART * share.sum(axis=1))[:, None]
    # A block next to an empty one is the same key whichever is empty; once is enough.
    empty = share == 0
    first_empty = empty.argmax(axis=1)[:, None]
    again = (empty[:, i] & (i != first_empty)) | (empty[:, j] & (j != first_empty))
    return mix((own[:, i] + own[:, j]).reshape(-1)).reshape(-1, len(PAIRS)), fair & ~again


def short_keys(form: bytes) -> np.ndarray:
    """Keys of a short line and of what is left of it without one letter: lines one edit apart share one."""
    text = form.decode()
    forms = {text} | {text[:k] + text[k + 1 :] for k in range(len(text))}
    return np.frombuffer(b"".join(blake2b(x.encode(), digest_size=8).digest() for x in sorted(forms)), dtype=U64)


def common_start(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def apart(a: str, b: str) -> tuple[str, str]:
    """Two texts without their common prefix and suffix."""
    same = common_start(a, b)
    a, b = a[same:], b[same:]
    same = common_start(a[::-1], b[::-1])
    return a[: len(a) - same], b[: len(b) - same]


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Levenshtein distance, or some number above `limit` if it is; a column of the table at a time, its steps up and down as bits of two integers."""
    a, b = apart(a, b)
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, list[int]] = {}
    for k, c in enumerate(a):
        places.setdefault(c, []).append(k)
    where = {}
    for c, at in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        where[c] = int.from_bytes(bits, "little")
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, lower = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(right & last) - bool(lower & last)
        if limit is not None and distance - left > limit:
            return distance - left
        right = ((right << 1) | 1) & full
        up, down = ((lower << 1) & full) | (full & ~(diagonal | right)), right & diagonal
    return distance


def near_pairs(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Whether the edit distance of each pair is within what the similarity allows.

    Tables of edit distances are taken for many pairs at a time, those that need as many cells beside the diagonal together.
    Pairs that need more than BAND_WORDS numbers of 64, and those of short rests, are compared one by one.
    """
    most = ((1 - similarity) * np.array([max(len(p), len(q)) for p, q in zip(left, right)]) + 1e-9).astype(np.int64)
    left, right = zip(*map(apart, left, right)) if left else ((), ())
    sizes = np.array([[len(x) for x in left], [len(x) for x in right]], dtype=np.int64).reshape(2, -1)
    words = most // 32 + 1
    banded = (words <= BAND_WORDS) & (np.maximum(most, BAND_LEAST) <= sizes.min(axis=0)) & (np.abs(sizes[0] - sizes[1]) <= most)
    out = np.zeros(len(left), dtype=bool)
    for k in np.flatnonzero(~banded).tolist():
        out[k] = edit_distance(left[k], right[k], int(most[k])) <= most[k]
    order = np.flatnonzero(banded)
    longer = sizes.max(axis=0)
    order = order[np.lexsort((longer[order], words[order]))]
    piece = np.cumsum(longer[order] + 64 * words[order]) // BAND_CELLS
    cut = np.flatnonzero((np.diff(piece) > 0) | (np.diff(words[order]) > 0)) + 1
    for part in np.split(order, cut) if len(order) else ():
        near = band_distances([left[k] for k in part.tolist()], [right[k] for k in part.tolist()], most[part], int(words[part[0]]))
        out[part] = near <= most[part]
    return out


def letters_at(texts: list[str], size: np.ndarray, start: np.ndarray, width: int, fill: int) -> np.ndarray:
    """A row for each text, its letters as numbers from place `start` on, `fill` elsewhere."""
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    out[np.repeat(np.arange(len(texts)), size), ragged(start, size)] = flat
    return out


def band_distances(left: list[str], right: list[str], most: np.ndarray, words: int) -> np.ndarray:
    """Levenshtein distance of each pair, or some number above `most` if it is; a column of all tables at a time, as steps up and down.

    Of a column the cells about the diagonal are the bits of `words` numbers, which hold 2 * most + 1 of them; no text is shorter than `most`.
    The distance is followed down the lower edge of that band to the last row, and then along the row (Hyyrö).
    """
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    one, cells = U64(1), 64 * words
    a = letters_at(left, m, cells - 1 - most, int(max(n.max(), (m + cells - most).max())) + cells, 0xFFFFFFFF)
    b = letters_at(right, n, np.zeros_like(n), int(n.max()), 0xFFFFFFFE)
    packed = lambda cell: np.ascontiguousarray(np.packbits(cell, axis=1, bitorder="little").view(U64).T)
    up = packed(np.arange(cells) >= (cells - 1 - most)[:, None])
    down = np.zeros_like(up)
    distance, out, row = most.copy(), np.where(n > 0, 4 * most + cells, m), np.arange(len(m))
    turn, limit = m - most, 2 * most + n - m
    for k in range(int(n.max())):
        match = packed(a[:, k : k + cells] == b[:, k, None])
        total = (match & up) + up
        for w in range(1, words):
            over = total[w - 1] < up[w - 1] if w == 1 else (plain < up[w - 1]) | (total[w - 1] < plain)
            plain = total[w].copy()
            total[w] += over
        diagonal = (total ^ up) | match | down
        right_, left_ = down | ~(diagonal | up), diagonal & up
        along = k - turn
        at = np.clip(cells - 2 - along, 0, cells - 1)
        place, bit = (at >> 6, np.arange(len(at))), (at & 63).astype(U64)
        step = ((right_[place] >> bit) & one).astype(np.int64) - ((left_[place] >> bit) & one).astype(np.int64)
        distance += np.where(along < 0, 1 - (diagonal[-1] >> U64(63)).astype(np.int64), step)
        lower = diagonal >> one
        lower[:-1] |= diagonal[1:] << U64(63)
        up, down = left_ | ~(lower | right_), lower & right_
        done = n == k + 1
        out[row[done]] = distance[done]
        if k % 8 == 7:
            goes = (n > k + 1) & (distance <= limit)
            if not goes.any():
                break
            if goes.sum() < 0.8 * len(goes):
                a, b, n, distance, row, turn, limit = (x[goes] for x in (a, b, n, distance, row, turn, limit))
                up, down = up[:, goes], down[:, goes]
    return out


def gram_bits(text: str, sizes: list[int]) -> list[np.ndarray]:
    """Bitmaps of a text for lines of some sizes: whether an odd number of its runs of GRAM letters fall on a bit.

    The second occurrence of a run, the third and so on are runs of their own. Texts that are `k` edits apart differ in at most 2 * GRAM * k bits of those for one size.
    """
    edge = "\0" * (GRAM - 1)
    letter = np.frombuffer(f"{edge}{text}{edge}".encode("utf-32-le"), dtype="<u4").astype(U64)
    runs = np.sort(sum(letter[k : len(letter) - GRAM + 1 + k] << U64(21 * k) for k in range(GRAM)))
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    again = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    runs = mix(mix(runs) + again.astype(U64))
    bits = [min(MOST_BITS, max(LEAST_BITS, 1 << (GRAM_BITS * n - 1).bit_length())) for n in sizes]
    return [np.packbits((np.bincount((runs & U64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).view(np.int64) for n in bits]


def normal_forms(block: Block, first: np.ndarray, end: np.ndarray, which: np.ndarray) -> list[bytes]:
    """The normal forms of some lines: their words, one space apart."""
    text = block.data.tobytes()
    words = lambda k: zip(block.starts[first[k] : end[k]].tolist(), block.ends[first[k] : end[k]].tolist())
    return [b" ".join(text[a:b] for a, b in words(k)) for k in which.tolist()]


def lines_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "text_hash"))
        for block in normal_blocks(batch):
            doc, number, first, end = worded_lines(block)
            if not len(doc):
                continue
            words = block.word_hashes()
            line = span_hashes(words, first, end)
            points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            per_word = points[block.ends] - points[block.starts]
            letters = np.concatenate([[0], np.cumsum(per_word)])
            size = letters[end] - letters[first] + (end - first) - 1
            near = [x.tobytes() for x in simhashes(words, per_word, first, end)]
            short = np.flatnonzero(size < SHORT)
            for k, form in zip(short.tolist(), normal_forms(block, first, end, short)):
                near[k] += form
            columns = (ids[block.first + doc], hashes[block.first + doc], number, line.view(np.int64), pa.array(near, pa.binary()), size)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc", "text_hash", "number", "line", "near", "size"])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, number, line, near, size) of every line with a word; size is the normal form's length, which short lines have after their NEAR."""
    return docs.mapInArrow(lines_of_batch, "doc long, text_hash long, number long, line long, near binary, size long")


def line_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys one after another, how many each line has, SimHash of all its words)."""
    rows, size = batch.column("near").to_pylist(), batch.column("size").to_numpy(zero_copy_only=False)
    near = np.frombuffer(b"".join(x[: NEAR.itemsize] for x in rows), dtype=NEAR)
    key, counts = block_keys(near)
    counts &= (size >= SHORT - 2)[:, None]
    own = np.repeat(np.arange(len(rows)), counts.sum(axis=1))
    keys = key[counts]
    short = np.flatnonzero((size >= LEAST) & (size < SHORT)).tolist()
    parts = [short_keys(rows[k][NEAR.itemsize :]) for k in short]
    keys, own = np.concatenate([keys, *parts]), np.concatenate([own, np.repeat(short, [len(x) for x in parts]).astype(np.int64)])
    order = np.argsort(own, kind="stable")
    return keys[order], np.bincount(own, minlength=len(rows)), near["whole"].copy()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, normal) of the lines in `wanted`. A filter made of shards keeps most other lines inside their task."""
    wanted = cut_lineage(wanted.distinct(), "lines-wanted")
    twice = lambda batch: np.repeat(batch.column("line").to_numpy(zero_copy_only=False).view(U64), 2)
    known = docs.sparkSession.sparkContext.broadcast(sketch(wanted, cell_count(wanted.count(), CELLS_PER_LINE), twice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in normal_blocks(batch):
                _, _, first, end = worded_lines(block)
                line = span_hashes(block.word_hashes(), first, end)
                _, once = np.unique(line, return_index=True)
                once = once[known.value(line[once])]
                normal = [x.decode() for x in normal_forms(block, first, end, once)]
                yield pa.RecordBatch.from_arrays([pa.array(line[once].view(np.int64)), pa.array(normal, pa.string())], ["line", "normal"])

    found = docs.select("text").mapInArrow(run, "line long, normal string")
    out = cut_lineage(found.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("normal").alias("normal")), "lines-texts")
    discard(wanted)
    return out


def removed_lines(docs: DataFrame, similarity: float = EDIT_SIMILARITY) -> DataFrame:
    """(doc, text_hash, number) of every line that is not its group's first; `docs` has doc, text and text_hash."""
    lines = cut_lineage(lines_of(docs), "lines-all")
    first = F.min(F.struct("doc", "text_hash", "number")).alias("first")
    once = cut_lineage(lines.groupBy("line").agg(first, F.min("near").alias("near"), F.min("size").alias("size"), F.count(F.lit(1)).alias("times")), "lines-distinct")
    rows = once.select("line", "near", "size")
    cells = cell_count(once.count() * len(PAIRS), CELLS_PER_KEY)
    shared = docs.sparkSession.sparkContext.broadcast(sketch(rows, cells, lambda batch: line_keys(batch)[0]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, whole = line_keys(batch)
            stays = shared.value(keys)
            own = np.repeat(np.arange(len(counts)), counts)[stays]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(counts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[stays].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(whole.view(np.int64)), lists], ["id", "sketch", "keys"]).filter(pa.array(np.diff(offsets) > 0))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(x[:8] for x in batch.column("near").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(whole), batch.column("size")], ["id", "sketch", "size"])

    held = cut_lineage(rows.mapInArrow(keyed, "id long, sketch long, keys array<long>"), "lines-keys")
    members = shared_members(held, len(PAIRS), "lines", DISTANCE)
    ids = members.select(F.col("id").alias("line")).distinct()
    hashes = cut_lineage(rows.join(ids, "line", "left_semi").mapInArrow(sketched, "id long, sketch long, size long"), "lines-sketches")
    texts = texts_of(docs, ids)
    discard(held)

    def edits(x: str, y: str) -> Column:
        """Edits that the similarity allows."""
        return F.floor((1 - similarity) * F.greatest(f"{x}.size", f"{y}.size") + 1e-9)

    def near(x: str, y: str) -> Column:
        """SimHashes near enough, unless short, and lengths that the edit similarity allows."""
        longer = F.greatest(f"{x}.size", f"{y}.size")
        fits = F.abs(F.col(f"{x}.size") - F.col(f"{y}.size")) <= edits(x, y)
        return fits & ((longer < SHORT) | (F.bit_count(F.col(f"{x}.sketch").bitwiseXOR(F.col(f"{y}.sketch"))) <= DISTANCE))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = near_pairs(batch.column("p").to_pylist(), batch.column("q").to_pylist(), similarity)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = hashes.alias("x"), hashes.alias("y")
        both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & near("x", "y"))
        both = cut_lineage(both.select("a", "b"), "lines-near")
        both = both.join(texts.select(F.col("line").alias("a"), F.col("normal").alias("p")), "a")
        return both.join(texts.select(F.col("line").alias("b"), F.col("normal").alias("q")), "b").mapInArrow(alike, "a long, b long")

    def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A line at each step it may be linked at, its own and those next to it, with its bitmap for that."""
        for batch in batches:
            rows = ((*x, near) for x in zip(*(batch.column(c).to_pylist() for c in ("id", "size", "step", "normal"))) for near in [[x[2] - 1, x[2], x[2] + 1]])
            out = [
                (id_, size, at, at == step, bits)
                for id_, size, step, normal, near in rows
                for at, bits in zip(near, gram_bits(normal, [math.ceil(similarity ** -(at + 1)) for at in near]))
            ]
            columns = zip(*out) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["id", "size", "at", "own", "grams"])

    def across(open_: DataFrame) -> DataFrame:
        # Lengths that may be linked are at most one step of this scale apart.
        step = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / similarity)).cast("int")
        wanted = open_.select("id").distinct().join(hashes.select("id", "size", step.alias("step")), "id")
        grams = cut_lineage(wanted.join(texts, F.col("id") == F.col("line")).mapInArrow(with_grams, "id long, size long, at int, own boolean, grams array<long>"), "lines-grams")
        known = open_.join(hashes.select("id", "sketch"), "id").join(grams, "id")
        x, y = known.where("own").alias("x"), known.alias("y")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.label") < F.col("y.label"))
        # Lines that have but frequent words in common meet in numbers that grow with their square; the bitmaps set them aside.
        turned = F.aggregate(F.zip_with("x.grams", "y.grams", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
        return x.join(y, same & near("x", "y") & (turned <= 2 * GRAM * edits("x", "y"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    labels = linked(members, verify, across, "lines")
    grouped = once.join(labels.withColumnRenamed("id", "line"), "line", "left").select("line", "first", "times", F.coalesce("label", "line").alias("label"))
    grouped = cut_lineage(grouped, "lines-grouped")
    discard(members, hashes, texts, labels, once)
    # Lines of their own that occur once stay; only the others are looked up in the texts.
    firsts = grouped.groupBy("label").agg(F.min("first").alias("keep"), F.sum("times").alias("all")).where(F.col("all") > 1)
    doubled = cut_lineage(grouped.join(cut_lineage(firsts, "lines-firsts"), "label").select("line", "keep"), "lines-doubled")
    gone = lines.join(doubled, "line").where(F.struct("doc", "text_hash", "number") != F.col("keep"))
    out = cut_lineage(gone.select("doc", "text_hash", "number"), "lines-gone")
    discard(lines, grouped, doubled)
    return out


def without_double_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = EDIT_SIMILARITY) -> DataFrame:
    """The documents with the texts that remain, and n_lines and n_removed."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(LAST)))
    text = F.col(f"`{text_col}`").cast("string")
    lines = docs.select(key.alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), text.alias("text"))
    gone = removed_lines(lines, similarity).groupBy("doc", "text_hash").agg(F.collect_list("number").alias("gone"))
    own = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed"}]
    row = F.struct(*(F.col(f"`{c}`") for c in own if c != text_col), F.lit(0).alias("_"))
    given = docs.select(row.alias("row"), text.alias("text"), key.alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash"))
    joined = given.join(gone, (F.col("id") == F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left").select("row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, counts, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                parts = [] if text is None else text.split("\n")
                out = set(gone or ())
                counts.append(len(parts))
                removed.append(len(out))
                texts.append(text if not out else "\n".join(x for k, x in enumerate(parts) if k not in out))
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(x, t) for x, t in zip((texts, counts, removed), kinds))], ["row", "text", "n_lines", "n_removed"]
            )

    schema = joined.select("row", "text").schema.add("n_lines", "long").add("n_removed", "long")
    columns = (F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own)
    return joined.mapInArrow(run, schema).select(*columns, "n_lines", "n_removed")


@register("op9_lines")
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = without_double_lines(docs)
    return rest.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
