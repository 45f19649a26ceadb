"""A copy of which only blank lines are left goes."""

import corpus_pipeline as p


def test_blank_lines_are_no_text(spark):
    first = "the cat sat on a mat\n\n\nand then it saw the other dog"
    copies = ["the cat sat on a mat\n\n\nand then it saw the other dog", "the cat sat on a mat\n\t\r\n \x0b\x0c\nand then it saw the other dog"]
    rest = ["the cat sat on a mat\n\n***", "\n\n"]
    rows = [(k, x, "en", "s", len(x)) for k, x in enumerate([first, *copies, *rest])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in p.lines(spark, docs, "").collect()}
    assert got == {0: first, 3: "\n***", 4: "\n\n"}
