"""Packed bits, random access and the file round trip."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op4_tokenfiles as m
from tidewatch.llm.sharedfiles import opened

PARTS = ["a", "é", "Σ", "ς", " ", "\t", "́", " ", "\x1c", "\x01", " \x01 ", "\x85", "<|endoftext|>", "the", "'s", "'", "s", "Don't", "12", "!?", "<|", "<|ENDOFTEXT|>", "I\u0307", "A\u0301", "K", "x'lly", "_", "\x1f", "\n", "日本", "İ", "ǅ", "\x00"]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 3001, dtype=np.uint64).astype(np.uint32)
    data = m.pack(ids, bits)
    assert len(data) == -(-3001 * bits // 8)
    assert (m.unpack(data, 3001, bits) == ids).all()


def test_encoder_is_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(20000)] + [None, "", "x" * 3000]
    coder = m.WordEncoder(m.vocabulary_path())
    ids, counts = coder.encode(texts, 2)
    want = [e.ids + [2] for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_files(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-500, 500), " ".join(rng.choices(PARTS, k=rng.randint(0, 200))), 1) for _ in range(400)]
    rows = [*{r[0]: r for r in rows}.values()] + [(None, "no id", 1), (1000, None, 1), (1001, "word " * 5000, 1), (2000, "same", 1), (2000, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(7)
    files = m.write_files(docs, m.vocabulary_path())
    got = m.read_files(files).collect()
    library = m.WordEncoder(m.vocabulary_path()).tokenizer
    at = 0
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    for r, (key, text, _) in zip(by_start, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    for f in files.collect():
        assert f.bits == 16
        with opened(f.path) as source:
            file = m.TokenFile(source)
            whole = file.ids(0, file.n_ids)
            assert len(whole) == f.n_ids
            for _ in range(20):
                a, b = sorted(rng.randrange(file.n_ids + 1) for _ in range(2))
                assert (file.ids(a, b) == whole[a:b]).all()


def test_empty_and_incomplete(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.read_files(m.write_files(docs, m.vocabulary_path())).collect() == []
    assert m.read_files(m.write_files(spark.createDataFrame([(1, None)], "doc_id long, text string"), m.vocabulary_path())).first().n_tokens == 1
    (tmp_path / "cut").write_bytes(b"TWBITS01" + bytes(100))
    with opened(str(tmp_path / "cut")) as source, pytest.raises(ValueError):
        m.TokenFile(source)
