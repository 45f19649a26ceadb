"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_language import plain_predict, top, plain_grams
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_linking import union
from tests.llm.test_minhash import shingles
from tests.llm.test_mixing import plain as plain_mix
from tidewatch.llm import op2_sentencepiece as pieces
from tidewatch.llm import op8_language as language
from tidewatch.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)
    words = {"en": "the cat sat on a mat and then it saw the other dog near that house".split(), "de": "der hund läuft über die straße und das ist nicht gut für ihn".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "de"])
        lines = [" ".join(rng.choices(words[lang], k=rng.randint(6, 25))) + f" {rng.choice('xyz')}{i}" for _ in range(rng.randint(1, 4))]
        rows.append([i, "\n".join(lines), lang, rng.choice(["s0", "s0", "s0", "s1", "s2", None])])
    for k in range(8):  # near copies: a word changed in each of many lines' stead, so that lines differ
        base = rows[k][1].replace("\n", " ").split()
        rows.append([200 + k, " ".join(base * 3), rows[k][2], "s1"])
        rows.append([300 + k, " ".join((base * 3)[:-1] + ["changed"]), rows[k][2], "s2"])
    rows += [[400 + k, rows[k][1], rows[k][2], "s0"] for k in range(20)]  # exact copies
    rows += [[500, None, "en", "s0"], [501, "", "en", "s0"], [502, "1234 !! 5678", "en", "s0"], [503, "the cat\nthe cat", None, "s3"], [503, "the cat\nthe cat", None, "s3"], [504, "this dog saw a house and the cat never did see it at all", "en", "s1"], [504, "then it sat on that mat near the other house with no dog", "en", "s2"], [None, "it saw the house that nobody else did", "en", "s3"]]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(corpus(), SCHEMA).repartition(5), []
    for name, stage in p.STAGES:
        docs = cut_lineage(stage(spark, docs, ""), f"test-{name}")
        out.append(docs)
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_columns(stages):
    assert [df.columns for df in stages[:-1]] == [COLUMNS] * 4
    assert [n for n, _ in p.STAGES] == ["language", "lines", "near_duplicates", "mixing", "pieces"]


def test_language(spark, stages):
    rows = corpus()
    held = {r[0] for r in spark.createDataFrame(rows, SCHEMA).where(language.held_out(F.col("doc_id"))).collect()}
    counts = {}
    for i, text, lang, *_ in rows:
        if lang and text is not None and i not in held:
            counts[lang] = counts.get(lang, type(plain_grams(""))()) + plain_grams(text)
    known = {lang: top(c, language.PROFILE) for lang, c in counts.items()}
    found = plain_predict([r[1] for r in rows], known, language.PROFILE)
    want = [r for r, (lang, score) in zip(rows, found) if lang != "und" and score >= p.LEAST_SCORE]
    assert sorted(rows_of(stages[0]), key=repr) == sorted(want, key=repr)
    assert not {500, 501, 502} & {r[0] for r in want} and len(want) >= len(rows) - 5


def test_lines(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    kept, _ = plain_lines([(r[0], r[1]) for r in before])
    want = sorted(((i, text, len(text)) for i, text, _, gone in kept if not gone or re.search(r"[^\x20\x09-\x0D]", text)), key=repr)
    assert sorted(((r[0], r[1], r[4]) for r in after), key=repr) == want
    assert len(after) < len(before)


def test_near_duplicates(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    known = [((i, text), shingles(text)) for i, text in sorted({(r[0], r[1]) for r in before if r[0] is not None})]
    edges = [(min(a, b), max(a, b)) for k, (a, x) in enumerate(known) for b, y in known[:k] if len(x & y) >= 0.8 * len(x | y)]
    group = {a: a for a, _ in known} | union(edges)
    assert sorted((r[0], r[1]) for r in after if r[0] is not None) == sorted({group[a] for a, _ in known})
    assert sum(r[0] is None for r in after) == sum(r[0] is None for r in before) and set(after) <= set(before)
    assert edges
    # Rows of one id with quite different texts all stay.
    assert {r[1] for r in after if r[0] == 504} == {r[1] for r in before if r[0] == 504} and sum(r[0] == 504 for r in after) == 2


def test_mixing(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    want, _ = plain_mix([(r[0], r[1], r[3]) for r in before])
    taken = sorted(((s, n, size, 0) for s, n, size, t in want for _ in range(t // n if n else 0)), key=repr)
    total = {s: size for s, _, size, _ in want}
    assert sorted(((r[3], len(r[1].split()), total[r[3]], 0) for r in after), key=repr) == taken
    assert set(after) <= set(before)


def test_pieces(stages):
    library = pieces.codec(pieces.model_path()).library
    want = []
    for i, text, *_ in rows_of(stages[3]):
        ids = library.encode(text, add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(library.decode(ids).encode())))
    assert sorted(rows_of(stages[4]), key=repr) == sorted(want, key=repr)


def test_empty_and_extra_columns(spark):
    """Names that stages use themselves, on an empty table and on a small one."""
    clash = spark.createDataFrame(
        [(1, "the cat sat on the mat", "en", "s", 22, 1, 2, "x", "y", "z")], SCHEMA + ", copies int, score int, row string, place string, gone string"
    )
    for docs in (clash.where("false"), clash):
        n = docs.count()
        for name, stage in p.STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, ""), f"test-extra-{name}")
            assert docs.columns == clash.columns
        assert docs.count() == n and cut_lineage(p.pieces(spark, docs, ""), "test-extra").count() == n
