"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id. A source that gives `full` whole copies and a rest takes,
once more, the documents whose hash lies below a threshold. The threshold is found digit by
digit: words are summed by source and by the next digit of the hash, the digit in which the
running sum passes the budget is kept, and only documents of that bucket are summed for the
next digit. Nothing is sorted, a smaller budget takes a subset of a larger one's documents,
and a source that holds most rows is only ever summed with map-side combine.

Null texts have size 0, a null source is a source of its own and comes last, null ids hash as
the word null. Rows with one id in one source share their hash and are taken together. Sources
without words get target 0. Texts of any length are counted whole. An empty table gives no rows. Input columns are kept by the
general form; a clash with its result columns is resolved in favour of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DIGITS, DIGIT_BITS = 5, 12
HASH_BITS = DIGITS * DIGIT_BITS


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place_of(key: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target of each source: `share` of all words by weight, at most `most` times its own.

    What a full source can't take is shared by weight among the others until none is above its
    limit. In order of limit per weight, a source is full if its limit is at most its share of
    what the sources before it have left. One row per source.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    s = s.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("full", F.col("ratio") <= F.col("left") / F.sum("weight").over(rest))
    level = (F.max("budget").over(everything) - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(F.col("full"), 0.0).otherwise(F.col("weight"))
    ).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level))
    return s.select("source", "source_size", F.least("target", "limit").alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source its whole copies and the hash below which a document is taken once more.

    `sized` has source, place and size; `goals` has source, source_size and target.
    """
    full = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    state = goals.select(
        "source", "source_size", "target", full.cast("long").alias("full"),
        (F.col("target") - full * F.col("source_size")).alias("want"), F.lit(0).cast("long").alias("below"),
    )
    for digit in range(DIGITS):
        shift = HASH_BITS - DIGIT_BITS * (digit + 1)
        prefix = F.shiftright("place", shift + DIGIT_BITS) if digit else F.lit(0).cast("long")
        inside = sized.join(state, (sized.source.eqNullSafe(state.source)) & (prefix == F.col("below")))
        sums = inside.groupBy(state.source, state.below, state.want, F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source", "below").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = sums.withColumn("upto", F.sum("words").over(run))
        # The bucket in which the sum passes the budget. The last digit's bucket is one hash value: the nearer side wins.
        passed = F.col("upto") > F.col("want") if digit < DIGITS - 1 else F.col("upto") - F.col("words") / 2 > F.col("want")
        border = summed.where(passed).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("b"))
        end = F.lit((1 << DIGIT_BITS * (digit + 1))).cast("long")
        s, b = state.alias("s"), border.alias("b")
        state = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source")), "left").select(
            "s.source", "s.source_size", "s.target", "s.full",
            (F.col("s.want") - F.coalesce(F.col("b.b.before"), F.lit(0))).alias("want"),
            # No bucket passes: all of the bucket before it lies below.
            F.coalesce(F.col("b.b.bucket"), F.when(F.lit(digit == 0), end).otherwise((F.col("s.below") + 1) * (1 << DIGIT_BITS))).alias("below"),
        )
        state = cut_lineage(state, f"mix-digit{digit}")
    return state


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.0, weights: tuple = WEIGHTS, most: int = MOST_COPIES,
) -> DataFrame:
    """The documents' own columns with size, source_size, target, taken (words the mix takes, repeats counted) and copies."""
    own = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken", "copies"}]
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), words_in(F.col(f"`{text_col}`").cast("string")).alias("size"),
        place_of(F.col(f"`{id_col}`")).alias("place"), F.col(f"`{source_col}`").alias("source"),
    )
    sized = cut_lineage(marked.select("source", "place", "size"), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    bounds = thresholds(sized, cut_lineage(targets(sizes, share, weights, most), "mix-targets"))
    # One row per source, read from a written table: Spark broadcasts it if its size allows, else splits skewed sources.
    bounds = bounds.select(F.col("source").alias("of"), "below", "full", "source_size", "target")
    copies = F.col("full") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    return marked.join(bounds, F.col("source").eqNullSafe(F.col("of"))).select(
        *(F.col("row")[c].alias(c) for c in own), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


SQL = rf"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {HASH_BITS // 4}))::BIGINT AS place FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
    FROM d GROUP BY source),
r AS (
    SELECT *, 3.0 * source_size AS lim, sum(source_size) OVER ()::DOUBLE AS budget, 3.0 * source_size / weight AS ratio FROM s),
f AS (
    SELECT *, ratio <= (budget - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM r),
t AS (
    SELECT source, source_size, CASE WHEN is_full THEN lim ELSE least(lim, weight * (budget - sum(CASE WHEN is_full THEN lim ELSE 0.0 END) OVER ())
        / sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER ()) END AS target FROM f),
g AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
c AS (
    SELECT d.*, source_size, target, copies, target - copies * source_size AS want,
        sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY d.source, place) AS own
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
    (size * (copies + CASE WHEN upto - own / 2.0 <= want THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@register("op7_mixing", SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
