"""The registered queries that SQL cannot express, on the smallest tables, against plain Python."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.test_forest import plain as plain_nearest
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_linking import union
from tests.llm.test_minhash import shingles
from tidewatch.llm import op2_sentencepiece, op4_tokenfiles
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def rows_of(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op2(spark, docs):
    library = op2_sentencepiece.codec(op2_sentencepiece.model_path()).library
    want = []
    for i, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode())))
    assert rows_of(spark, "op2_sentencepiece") == want


def test_op4(spark, docs):
    library = op4_tokenfiles.encoder(op4_tokenfiles.vocabulary_path()).tokenizer
    want, at = [], 0
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [op4_tokenfiles.END_ID]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert rows_of(spark, "op4_tokenfiles") == want


def test_op6(spark, docs):
    sets = [(i, shingles(t)) for i, t in docs]
    edges = [(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= 0.8 * len(x | y)]
    assert rows_of(spark, "op6_minhash") == sorted(({i: i for i, _ in docs} | union(edges)).items())


def test_op9(spark, docs):
    """Truth is edit similarity alone. The blocks miss pairs whose letters differ here and there, so a group may fall
    apart and keep a line more; no line goes that the truth keeps, and nearly all go that should."""
    want, edges = plain_lines(docs)
    want = {i: (n, gone, sha((text or "").encode())) for i, text, n, gone in want}
    got = {i: (n, gone, digest) for i, n, gone, digest in rows_of(spark, "op9_lines")}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] <= want[i][1] for i in want)
    assert all(got[i] == want[i] for i in want if got[i][1] == want[i][1])
    assert edges and sum(x[1] for x in got.values()) >= 0.9 * sum(x[1] for x in want.values())


def test_op10(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"])
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    got = rows_of(spark, "op10_forest")
    hits = 0
    queries = [i for i, _ in rows if i % 50 == 0]
    for q in queries:
        want, found = plain_nearest(rows, q), [(v, s) for i, _, v, s in got if i == q]
        assert len(found) == 5 and [r for i, r, _, _ in got if i == q] == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in want} & {v for v, _ in found})
        exact = dict(plain_nearest(rows, q, len(rows)))
        assert all(s == pytest.approx(exact[v], abs=1e-14) for v, s in found)
    assert hits >= 0.9 * 5 * len(queries)
