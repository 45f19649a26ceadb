"""Feature preparation: labels, repair, scaling, splits, sequences, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ordered, skew
from tidewatch.operators.rules import literal_map

# The eight classes in label order, raw capture labels, class weights.
CLASSES = ["BENIGN", "Botnet", "BruteForce", "DDoS", "DoS", "Infiltration", "PortScan", "WebAttack"]
RAW_LABELS = {
    "BENIGN": "BENIGN",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "Heartbleed": "DoS",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
    "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce",
    "Bot": "Botnet",
    "Infiltration": "Infiltration",
}
CUSTOM_WEIGHTS = {
    "BENIGN": 1.0, "Botnet": 150.0, "BruteForce": 50.0, "DDoS": 18.0, "DoS": 9.0, "Infiltration": 500.0,
    "PortScan": 14.0, "WebAttack": 150.0,
}
WEIGHT_CAPS = {"Botnet": 150.0, "WebAttack": 150.0, "BruteForce": 50.0, "Infiltration": 200.0}
WINDOW, STRIDE = 10, 5


def class_label(raw: Column) -> Column:
    """Raw capture label to one of the eight classes."""
    web = F.regexp_replace(F.lower(raw), r"[�?]", "").rlike("brute|xss|sql|web")
    return F.coalesce(
        F.try_element_at(literal_map(RAW_LABELS), F.trim(raw)),
        F.when(web, "WebAttack").otherwise("BENIGN"),
    )


def repair(df: DataFrame, features: Sequence[str], file: str = "file") -> DataFrame:
    """Infinite -> NULL -> column maximum of the same file -> 0, as FLOAT."""
    finite = df.withColumns(
        {c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c).cast("double")) for c in features}
    )
    tops = finite.groupBy(file).agg(*[F.max(c).alias(f"__max_{c}") for c in features])
    joined = skew.salted_join(finite, tops, [file])
    fixed = {c: F.coalesce(c, f"__max_{c}", F.lit(0.0)).cast("float") for c in features}
    return joined.withColumns(fixed).select(*df.columns)


def concat_files(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_index") -> DataFrame:
    """0-based index in alphabetical order. The classes are a table of one row each, which Spark broadcasts if its size allows."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    numbered = names.withColumn(out, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(numbered, label, "left").select(*df.columns, out)


def decode_label(index: Column, classes: Sequence[str] = CLASSES) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return F.when(index.between(0, len(classes) - 1), F.try_element_at(names, index.cast("int") + 1)).otherwise(
        F.concat(F.lit("UNKNOWN_"), index.cast("string"))
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "label", fraction: float = 0.2, out: str = "is_test"
) -> DataFrame:
    """Mark ceil(fraction * n) rows of every class, chosen by the md5 of the key.

    Places inside a class come from 4096 hash slices, so the benign class, most of
    the table, is not ordered in one task. ``label`` has at most eight values.
    """
    placed = ordered.positions(
        df.withColumn("__chunk", ordered.hash_chunk(key)).withColumn("__h", F.md5(F.col(key).cast("string"))),
        [label], "__chunk", ["__h", key], "__pos",
    )
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("__take"))
    # eight rows; left to sizes, Spark may keep a sort-merge join, in which a task reads a whole class
    return (
        placed.join(F.broadcast(sizes), label)
        .withColumn(out, F.col("__pos") < F.col("__take"))
        .select(*df.columns, out)
    )


def minmax(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of every feature."""
    return train.agg(
        *[F.min(c).cast("double").alias(f"{c}_lo") for c in features],
        *[F.max(c).cast("double").alias(f"{c}_hi") for c in features],
    )


def scale(df: DataFrame, bounds: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - lo) / (hi - lo) without clipping; a constant column becomes x - lo."""
    one = df.crossJoin(F.broadcast(bounds))
    scaled = {}
    for c in features:
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        scaled[c] = (F.col(c).cast("double") - F.col(f"{c}_lo")) / F.when(span == 0, 1.0).otherwise(span)
    return one.withColumns(scaled).select(*df.columns)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") * 100 / F.col("t")).alias("percent"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: balanced n/(k n_c), the fixed table, and benign/n_c under caps."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"),
        F.coalesce(F.max(F.when(F.col(label) == "BENIGN", F.col("n"))), F.lit(0)).alias("b"),
    )
    raw = F.col("b") / F.greatest(F.col("n"), F.lit(1))
    cap = F.try_element_at(literal_map(WEIGHT_CAPS), F.col(label))
    return n.crossJoin(F.broadcast(total)).select(
        label, "n",
        (F.col("t") / (F.col("k") * F.col("n"))).alias("balanced"),
        F.coalesce(F.try_element_at(literal_map(CUSTOM_WEIGHTS), F.col(label)), F.lit(1.0)).alias("custom"),
        F.least(raw, F.coalesce(cap, raw)).alias("capped"),
    )


def sequences(
    df: DataFrame, label: str, chunk: str, order: Sequence[str], value: Column,
    window: int = WINDOW, stride: int = STRIDE,
) -> DataFrame:
    """Training windows per class: (label, start, items) with exactly ``window`` rows.

    Each row is sent to the at most window/stride windows it is part of and a window
    is a group of ten rows; no class is ever gathered.
    """
    placed = ordered.positions(df, [label], chunk, order, "__pos")
    last = F.floor(F.col("__pos") / stride)
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((window - 1) // stride)), lambda j: (last - j) * stride),
        lambda s: (s >= 0) & (F.col("__pos") - s < window),
    )
    return (
        placed.select(label, "__pos", value.alias("v"), F.explode(starts).alias("start"))
        .groupBy(label, "start")
        .agg(F.sort_array(F.collect_list(F.struct("__pos", "v"))).alias("i"))
        .filter(F.size("i") == window)
        .select(label, "start", F.transform("i", lambda x: x["v"]).alias("items"))
    )


def sequence_stats(df: DataFrame, label: str, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    short = F.col("rows") < window
    return n.withColumns(
        {
            "sequences": F.when(short, 0).otherwise(F.floor((F.col("rows") - window) / stride) + 1),
            "skipped": short,
        }
    )


def source_windows(
    flows: DataFrame, source: str, chunk: str, order: Sequence[str], value: Column, window: int = WINDOW
) -> DataFrame:
    """The last ``window`` vectors of the source at each flow; cold until there are enough."""
    out = ordered.trailing_rows(flows, [source], chunk, order, window, value, "recent")
    return out.withColumn("window_complete", F.size("recent") >= window)


def guard(vector: Column, size: int = 41) -> Column:
    """Why a vector cannot be scored; NULL if it can."""
    return (
        F.when(vector.isNull(), "zero_vector")
        .when(F.size(vector) != size, "wrong_shape")
        .when(F.forall(vector, lambda x: x == 0), "zero_vector")
    )
