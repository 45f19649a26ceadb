"""Rank-order profiles against plain Python, and accuracy on held-out documents."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import op8_language as m

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    out, s = Counter(), []
    for c in " " + text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or not s or s[-1] != " ":
            s.append(c)
    for n in (1, 2, 3):
        out.update(x for i in range(len(s) - n + 1) if (x := "".join(s[i : i + n])).strip())
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def plain_predict(texts, known, size):
    places = {lang: {g: k for k, g in enumerate(p)} for lang, p in known.items()}
    out = []
    for text in texts:
        own = top(plain_grams(text or ""), size)
        far = {lang: sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get) if own and far else "und"
        out.append((best, 1 - far[best] / (len(own) * size) if best != "und" else 0.0))
    return out


TRAIN = [("the cat sat on the mat and then the other", "en"), ("Der Hund läuft über die Straße, und das ist gut", "de"), ("l'été où le chat est là", "fr"), (None, "en"), ("x", None), ("1234", "de")]
TEXTS = ["the hat", "DIE STRASSE", "où", "", None, "123 !!", "ĳ İstanbul ǅ", "日本語 テキスト", "a", "the the the\nthe", "Straße" * 200]


@pytest.mark.parametrize("size", [5, 400])
def test_against_plain(spark, size):
    known = m.profiles(spark.createDataFrame(TRAIN, "text string, lang string"), size=size)
    want = {lang: top(sum((plain_grams(t) for t, x in TRAIN if x == lang and t), Counter()), size) for lang in ("en", "de", "fr")}
    got = {}
    for r in known.collect():
        got.setdefault(r.lang, {})[r.place] = r.gram
    assert {k: [code(g) for g in v] for k, v in want.items()} == {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = sorted(m.predict(docs, known, [F.col("doc_id")], size=size).collect())
    expected = plain_predict(TEXTS, want, size)
    assert [r.lang_pred for r in rows] == [e[0] for e in expected]
    assert [r.score for r in rows] == pytest.approx([e[1] for e in expected])
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_labelled_and_empty(spark):
    none = spark.createDataFrame([("a b", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, "a b", 0.5, "z"), (None, None, 0.5, "z"), (1, "a b", 0.5, "z")], "doc_id long, text string, score double, row string")
    rows = m.predict(docs, m.profiles(none), [F.col("doc_id"), F.col("row")]).collect()
    assert sorted((r.lang_pred, r.score, r.row) for r in rows) == [("und", 0.0, "z")] * 3
    assert m.predict(docs.where(F.lit(False)), m.profiles(none), [F.col("doc_id")]).collect() == []
    assert m.held_out(F.col("doc_id")) is not None and docs.where(m.held_out(F.lit(None).cast("long"))).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    rows = m.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
