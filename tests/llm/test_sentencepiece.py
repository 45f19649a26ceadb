"""Piece ids and decoded texts against the library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op2_sentencepiece as m

PARTS = ["a", "b", "e", "t", "h", " ", "  ", "   ", "\n", "▁", "▁▁", "é", "ß", "梦", "𝔸", "\x00", "<s>", "</s>", "<0x0A>", "the", "ing", "\t", " ", "😀", "\r\n", "zzz"]


@pytest.fixture(scope="module")
def codec():
    return m.PieceCodec(m.model_path())


def both(codec, texts):
    ids, counts = codec.encode(texts)
    edge = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(edge, counts)], [t.decode() for t in codec.decode(ids, counts)]


def test_random_texts(codec):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 50))) for _ in range(5000)]
    texts += ["", " ", "\n", "a" * 4000, " " * 3000, "ab" * 2000, "▁" * 77, "\n" * 40, "the " * 3000]
    ids, decoded = both(codec, texts)
    want = codec.library.encode(texts, add_bos=True, add_eos=True)
    assert ids == want
    assert decoded == codec.library.decode(want)


def test_same_after_forgetting(codec, monkeypatch):
    texts = ["some words here", "other words there"] * 3
    before = both(codec, texts)
    monkeypatch.setattr(m, "MAX_WORDS", 0)
    assert both(codec, texts) == before


def test_decoding_any_ids(codec):
    rng = random.Random(6)
    rows = [[rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    got = codec.decode(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    assert [t.decode() for t in got] == [codec.library.decode(r) for r in rows]


def test_query_form(spark, codec):
    docs = spark.createDataFrame([(3, "Hello  world\n", "x"), (None, None, "y"), (3, "Hello  world\n", "x")], "doc_id long, text string, ids string")
    rows = sorted(m.digests(docs, m.model_path()).collect(), key=lambda r: r.n_tokens)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2)] + [(3, rows[1].n_tokens)] * 2
    ids = codec.library.encode("Hello  world\n", add_bos=True, add_eos=True)
    assert rows[1].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(b"Hello  world\n").hexdigest()
    full = {r.doc_id: (np.frombuffer(r.ids, dtype="<u4").tolist(), r.decoded) for r in m.piece_codes(docs, m.model_path()).collect()}
    assert full == {3: (ids, "Hello  world\n"), None: ([codec.begin, codec.end], "")}
    assert m.digests(docs.where(F.lit(False)), m.model_path()).collect() == []
