"""Language identification by rank-order profiles.

A text's profile is its most frequent character n-grams (one to three characters, lower case,
runs of other characters than letters as one blank), most frequent first. Its distance to a
language is the sum, over its n-grams, of how far each is out of place in the language's
profile; an n-gram missing there counts as the profile's length. The least distance wins, the
first language in order of code points on a tie.

Training counts the n-grams of every labelled training document by language; each task sends
one row per language and n-gram, of which PROFILE a language stay. A language's profile is thus
a small table, whatever the corpus; languages are as many as the label column names.

Null texts and texts without a letter are `und` with score 0, as is everything if nothing is
labelled. Texts of any length are read whole; an empty table gives no rows. Repeated rows and null ids give one result row each. Columns other than those named
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.llm.textblocks import ragged

LENGTHS = (1, 2, 3)
PROFILE = 400
BLOCK_CHARS = 200_000
#: Distinct n-grams a training task holds before it sends them on.
HELD = 500_000
BLANK = 0x20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> itself if a letter, else a blank."""
    table = np.full(0x110000, BLANK, dtype=np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), by text and n-gram. N-grams are numbers, 21 bits a character, with no n-gram of blanks alone."""
    lowered = [" " + t.lower() + " " for t in texts]
    size = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = letters()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(texts)), size)
    blank = points == BLANK
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    points, owner = points[keep], owner[keep]
    docs, codes, counts = [], [], []
    for n in LENGTHS:
        if len(points) < n:
            continue
        code = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            code = (code << 21) | points[k : len(points) - n + 1 + k]
        whole = owner[: len(code)] == owner[n - 1 :]
        whole &= (points[: len(code)] != BLANK) | (points[n - 1 :] != BLANK) | (n == 3)
        # Most n-grams repeat: few distinct codes, so texts and codes fit in one sortable number.
        known, code = np.unique(code[whole], return_inverse=True)
        key, count = np.unique(owner[: len(whole)][whole] * len(known) + code, return_counts=True)
        docs.append(key // max(1, len(known)))
        codes.append(known[key % max(1, len(known))] if len(known) else key)
        counts.append(count)
    if not docs:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    doc, code, count = map(np.concatenate, (docs, codes, counts))
    lettered = code != ((BLANK << 42) | (BLANK << 21) | BLANK)
    doc, code, count = doc[lettered], code[lettered], count[lettered]
    order = np.argsort(doc, kind="stable")
    return doc[order], code[order], count[order]


def text_blocks(texts: pa.Array) -> Iterator[list[str]]:
    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        done = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, done + BLOCK_CHARS, side="right")))
        yield texts[row:end].to_pylist()
        row = end


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the `size` most frequent n-grams of each language, place 0 first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        room = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(times)], ["lang", "gram", "times"])
            held.clear()

        for batch in batches:
            names = batch.column("lang")
            for lang in sorted(set(names.to_pylist())):
                for texts in text_blocks(batch.column("text").filter(pc.equal(names, lang))):
                    _, code, times = grams(texts)
                    code, at = np.unique(code, return_inverse=True)
                    held.setdefault(lang, []).append((code, np.bincount(at, weights=times, minlength=len(code)).astype(np.int64)))
                    room += len(code)
                    if room > HELD:
                        for name, parts in held.items():
                            code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                            held[name] = [(code, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]
                        room = sum(len(p[0][0]) for p in held.values())
                        if room > HELD // 2:
                            yield from merged()
                            room = 0
        yield from merged()

    counts = (
        labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(count, "lang string, gram long, times long")
        .groupBy("lang", "gram")
        .agg(F.sum("times").alias("times"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Ranker:
    """The languages' profiles as one table: n-gram -> place in each profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.codes, gram), self.langs.index(lang)] = place

    def rank(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest language (-1: no letter) and its score: 1 less the distance's share of the largest possible."""
        doc, code, count = grams(texts)
        order = np.lexsort((code, -count, doc))
        doc, code = doc[order], code[order]
        own = np.bincount(doc, minlength=len(texts))
        place = ragged(np.zeros(len(own), dtype=np.int64), own)
        top = place < self.size
        doc, code, place = doc[top], code[top], place[top]
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        at = np.searchsorted(self.codes, code)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != code)] = len(self.codes)
        known = self.places[at]
        apart = np.where(known < 0, self.size, np.abs(known - place[:, None]))
        far = np.stack([np.bincount(doc, weights=apart[:, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        used = np.minimum(own, self.size)
        best = far.argmin(axis=1)
        score = 1 - far[np.arange(len(texts)), best] / np.maximum(1, used * self.size)
        return np.where(used > 0, best, -1), np.where(used > 0, np.clip(score, 0, 1), 0.0)


def predict(docs: DataFrame, known: DataFrame, columns: list[Column], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """`columns` of every document with lang_pred and score. `known`: what `profiles` gives, `size` rows a language."""
    rows = [tuple(r) for r in known.select("lang", "gram", "place").collect()]
    ranker = Ranker(rows, size)
    given = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*ranker.langs, "und"], dtype=object)
        for batch in batches:
            at = 0
            for texts in text_blocks(batch.column("text")):
                best, score = ranker.rank(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, len(texts)), pa.array(langs[best], pa.string()), pa.array(score, pa.float64())],
                    ["row", "lang_pred", "score"],
                )
                at += len(texts)

    schema = given.select("row").schema.add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out(key: Column) -> Column:
    """Whether a document is for testing: CRC-32 of its id as text leaves 2 modulo 4. A null id is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


@register("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = profiles(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, known, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
