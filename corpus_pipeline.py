"""Documents to training tokens: language, lines, near duplicates, source mix, pieces.

Every stage takes what its predecessor kept and returns the columns of `documents`, but for the
last, which returns the encoded rows. Each result is written below spark.checkpoint.dir and read
again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import op2_sentencepiece, op6_minhash, op7_mixing, op8_language, op9_lines
from tidewatch.session import cut_lineage

#: Texts whose nearest language profile is further than this are taken for no language at all.
LEAST_SCORE = 0.25


def whole(docs: DataFrame) -> Column:
    """A row as one value, so that no column's name can clash with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those near no language, go."""
    known = op8_language.profiles(docs.where(~op8_language.held_out(F.col("doc_id"))))
    marked = op8_language.predict(docs, known, [whole(docs)])
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no line is left but blank ones goes as well."""
    rest = op9_lines.without_double_lines(docs.select("doc_id", "text", whole(docs)))
    left = rest.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_removed") == 0, F.col("row")["n_chars"]).otherwise(F.length("text"))
    own = {"text": F.col("text"), "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return left.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id. Documents without an id stay.

    Rows that share an id but hold different texts are documents of their own (told apart by 64 bits of id and text).
    """
    own = F.xxhash64("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL")
    classes = op6_minhash.near_duplicates(named.select(own.alias("doc_id"), "text"))
    ids = named.select(own.alias("own"), "doc_id").distinct()
    first = ids.join(classes.withColumnRenamed("doc_id", "own"), "own").groupBy("class_id").agg(F.min(F.struct("doc_id", "own")).alias("first"))
    least = cut_lineage(first.select(F.col("first.own").alias("own")), "pipeline-least")
    kept = named.select(own.alias("own"), whole(docs)).join(least, "own", "left_semi").dropDuplicates(["own"])
    return kept.select("row.*").union(docs.where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    mixed = op7_mixing.mix(docs.select("doc_id", "text", "source", whole(docs))).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each row's piece ids and of the text decoded from them."""
    return op2_sentencepiece.digests(docs, op2_sentencepiece.model_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: SQL has no counterpart of rank-order profiles, groups of similar lines or piece encoding; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
