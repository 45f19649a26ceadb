"""Training and scoring: random forest, anomaly forest, sequence classifier."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics, ordered, prep
from tidewatch.operators.rules import literal_map

# Search grid (depth, rows per leaf, weight scheme); 30 is Spark's deepest tree.
GRID = [
    (d, leaf, w)
    for w in ("balanced", "custom")
    for d, leaf in ((None, 2), (None, 5), (None, 10), (50, 2), (50, 5), (30, 5))
]
SEARCH_WEIGHTS = {
    "BENIGN": 1.0, "Botnet": 150.0, "BruteForce": 50.0, "DDoS": 1.0, "DoS": 5.0, "Infiltration": 500.0,
    "PortScan": 2.0, "WebAttack": 150.0,
}
MAX_DEPTH = 30


def class_index(label: Column, classes: Sequence[str] = prep.CLASSES) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), label) - 1).cast("double")


def weighted(train: DataFrame, scheme: str = "balanced", label: str = "label") -> DataFrame:
    """Add the class weight. Labels are the eight classes, so the weights are eight rows."""
    if scheme == "custom":
        w = F.coalesce(F.try_element_at(literal_map(SEARCH_WEIGHTS), F.col(label)), F.lit(1.0))
        return train.withColumn("weight", w)
    w = prep.class_weights(train, label).select(label, F.col("balanced").alias("weight"))
    return train.join(F.broadcast(w), label)


def train_forest(
    train: DataFrame, features: Sequence[str], trees: int = 200, leaf: int = 2, depth: int | None = None,
    scheme: str = "balanced", label: str = "label", seed: int = 42,
) -> PipelineModel:
    ready = weighted(train, scheme, label).select(
        array_to_vector(F.array(*[F.col(c).cast("double") for c in features])).alias("x"),
        class_index(F.col(label)).alias("y"),
        "weight",
    )
    rf = RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, minInstancesPerNode=leaf,
        maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), seed=seed, probabilityCol="prob", rawPredictionCol="votes",
    )
    return Pipeline(stages=[rf]).fit(ready)


def forest_probabilities(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``probabilities``, one per class, 0 for classes the model has not seen."""
    x = array_to_vector(F.array(*[F.col(c).cast("double") for c in features]))
    out = model.transform(df.withColumn("x", x))
    p = vector_to_array("prob")
    full = F.transform(
        F.sequence(F.lit(1), F.lit(len(prep.CLASSES))), lambda i: F.coalesce(F.try_element_at(p, i), F.lit(0.0))
    )
    return out.withColumn("probabilities", full).select(*df.columns, "probabilities")


def scored_metrics(df: DataFrame) -> DataFrame:
    """Overall figures of argmax predictions from (label, probabilities)."""
    name, _ = metrics.predict_argmax(F.col("probabilities"))
    return metrics.overall(metrics.per_class(metrics.confusion(df.withColumn("pred", name))))


def grid_search(
    train: DataFrame, valid: DataFrame, features: Sequence[str], trees: int = 100, grid=GRID, parallel: int = 4
) -> DataFrame:
    """Fit every candidate, score it on the validation rows, mark the winner.

    Candidates are independent Spark jobs, a few are submitted side by side.
    """

    def fit(item):
        i, (depth, leaf, scheme) = item
        model = train_forest(train, features, trees, leaf, depth, scheme)
        m = scored_metrics(forest_probabilities(model, valid, features)).first()
        return i, depth, leaf, scheme, m["macro_f1"], m["fpr_overall"]

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(fit, enumerate(grid)))
    spark = train.sparkSession
    table = spark.createDataFrame(
        rows, "candidate int, depth int, leaf int, weights string, macro_f1 double, fpr double"
    )
    return metrics.grid_choice(table)


def refit_winner(candidates: DataFrame, train: DataFrame, features: Sequence[str], trees: int = 200) -> PipelineModel:
    """The chosen candidate of ``grid_search``, trained on all of ``train``."""
    best = candidates.filter("chosen").first()
    return train_forest(train, features, trees, best["leaf"], best["depth"], best["weights"])


# --- anomaly forest --------------------------------------------------------

TREES, SAMPLE = 100, 256


def _path_norm(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """One isolation tree as arrays: feature (-1 = leaf), cut, left child, depth value."""
    feature, cut, left, value = [-1], [0.0], [-1], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, pts, depth = todo.pop()
        lo, hi = (pts.min(0), pts.max(0)) if len(pts) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(pts) <= 1 or not len(open_):
            value[node] = depth + float(_path_norm(len(pts)))
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(lo[f], hi[f]))
        kid = len(feature)
        feature[node], cut[node], left[node] = f, c, kid
        feature += [-1, -1]
        cut += [0.0, 0.0]
        left += [-1, -1]
        value += [0.0, 0.0]
        below = pts[:, f] < c
        todo += [(kid, pts[below], depth + 1), (kid + 1, pts[~below], depth + 1)]
    return feature, cut, left, value


def train_anomaly_forest(
    benign: DataFrame, features: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """One row per tree (feature, cut, left, value arrays), each grown from its own
    sample of at most ``sample`` rows.

    A hash of (key, tree) decides where a row takes part, at a rate that leaves
    about twice the sample per tree; trees then grow in parallel, one group each.
    """
    total = benign.count()
    rate = min(1.0, 2.0 * sample / max(total, 1))
    cut = int(rate * 2**31)
    numbers = F.array(*[F.lit(i) for i in range(trees)])
    draw = lambda t: F.pmod(F.xxhash64(F.col(key).cast("string"), t, F.lit(seed)), F.lit(2**31))
    vec = F.array(*[F.col(c).cast("double") for c in features])
    chosen = benign.select(
        F.col(key).cast("string").alias("k"), vec.alias("x"), F.explode(F.filter(numbers, lambda t: draw(t) < cut)).alias("tree")
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        pdf = pdf.sort_values("k")
        take = rng.permutation(len(pdf))[:sample]
        x = np.vstack(pdf["x"].to_numpy())[take]
        f, c, left, v = _grow(x, rng, max(1, math.ceil(math.log2(max(2, len(x))))))
        return pd.DataFrame({"tree": [tree], "n": [len(x)], "feature": [f], "cut": [c], "left": [left], "value": [v]})

    return chosen.groupBy("tree").applyInPandas(
        grow, "tree int, n int, feature array<int>, cut array<double>, left array<int>, value array<double>"
    )


def _forest_arrays(model: DataFrame) -> list[tuple]:
    """The forest on the driver: at most trees x (2 x sample) numbers, by construction."""
    return [
        (np.array(r["feature"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["value"]), r["n"])
        for r in model.orderBy("tree").collect()
    ]


def anomaly_scores(df: DataFrame, model: DataFrame, features: Sequence[str], name: str = "sample_score") -> DataFrame:
    """Score every row: -2^(-mean path / expected path); lower is more anomalous."""
    shipped = df.sparkSession.sparkContext.broadcast(_forest_arrays(model))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        here = np.arange(len(x))
        total = np.zeros(len(x))
        norm = 0.0
        for feature, cut, left, value, n in shipped.value:
            node = np.zeros(len(x), dtype=int)
            for _ in range(64):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (x[here, np.maximum(f, 0)] >= cut[node])
                node = np.where(inner, step, node)
            total += value[node]
            norm += float(_path_norm(n))
        trees = max(1, len(shipped.value))
        return pd.Series(-np.power(2.0, -(total / trees) / max(norm / trees, 1e-12)))

    return df.withColumn(name, score(*[F.col(c).cast("double") for c in features]))


def contamination_offsets(train_scores: DataFrame, contaminations: Sequence[float]) -> DataFrame:
    """Offset per contamination: that quantile of the training scores, exactly."""
    parts = []
    for c in contaminations:
        q = ordered.exact_percentiles(train_scores, [], "sample_score", [c])
        parts.append(q.select(F.lit(float(c)).alias("contamination"), F.col(q.columns[0]).alias("offset")))
    return prep.concat_files(parts)


def decision(df: DataFrame, offset: DataFrame) -> DataFrame:
    """Raw decision value: sample score minus the (one-row) offset."""
    return df.crossJoin(F.broadcast(offset.select("offset"))).withColumn(
        "raw_score", F.col("sample_score") - F.col("offset")
    ).drop("offset")


# --- sequence classifier ---------------------------------------------------


def flatten_windows(windows: DataFrame, items: str = "items") -> DataFrame:
    """A window of vectors as one long vector."""
    return windows.withColumn("x", array_to_vector(F.flatten(items)))


def train_sequence_classifier(
    windows: DataFrame, width: int, label: str = "label", hidden: int = 64, rounds: int = 50, seed: int = 42
) -> PipelineModel:
    """Feed-forward network over flattened windows, eight classes."""
    ready = flatten_windows(windows).select("x", class_index(F.col(label)).alias("y"))
    net = MultilayerPerceptronClassifier(
        featuresCol="x", labelCol="y", layers=[width, hidden, len(prep.CLASSES)], maxIter=rounds, seed=seed,
        probabilityCol="prob", rawPredictionCol="out",
    )
    return Pipeline(stages=[net]).fit(ready)


def sequence_probabilities(model: PipelineModel, windows: DataFrame) -> DataFrame:
    out = model.transform(flatten_windows(windows))
    return out.withColumn("probabilities", vector_to_array("prob")).select(*windows.columns, "probabilities")
