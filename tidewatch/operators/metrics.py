"""Predictions, confusion metrics, thresholds, ROC, latency, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.prep import CLASSES
from tidewatch.session import cut_lineage

# Threshold grids.
COARSE = [0.05 + 0.02 * i for i in range(45)]
FINE = [0.1 + 0.025 * i for i in range(33)]
ANOMALY_GRID = [0.3 + 0.025 * i for i in range(25)]
ANOMALY_RAW = 0.1135


def _classes(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def predict_argmax(probs: Column, classes: Sequence[str] = CLASSES) -> tuple[Column, Column]:
    """Class of the first largest probability, and that probability."""
    top = F.array_max(probs)
    return F.element_at(_classes(classes), F.array_position(probs, top).cast("int")), top


def predict_thresholds(
    probs: Column, thresholds: Sequence[float], classes: Sequence[str] = CLASSES
) -> tuple[Column, Column]:
    """Class with the largest lead over its threshold; BENIGN if nobody leads."""
    gaps = F.zip_with(probs, F.array(*[F.lit(float(t)) for t in thresholds]), lambda p, t: p - t)
    best = F.array_max(gaps)
    at = F.array_position(gaps, best).cast("int")
    name = F.when(best <= 0, "BENIGN").otherwise(F.element_at(_classes(classes), at))
    return name, F.when(name == "BENIGN", 0.0).otherwise(F.element_at(probs, at))


def anomaly_gate(raw: Column, threshold: float = ANOMALY_RAW) -> tuple[Column, Column]:
    """(is_anomaly, confidence) of a raw anomaly score; low scores are anomalous."""
    return raw < threshold, 1.0 / (1.0 + F.exp(raw))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(cm: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    return cm.groupBy("label").agg(
        *[F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes]
    )


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cm: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Counts and rates per class from a confusion table."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("picked"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("picked"),
                 F.lit(0).cast("long").alias("tp")),
    )
    sums = cm.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("picked").alias("picked"), F.sum("tp").alias("tp")
    )
    total = cm.agg(F.sum("n").alias("total"))
    axis = cm.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    z = axis.join(sums, "class", "left").na.fill(0).crossJoin(F.broadcast(total))
    fp, fn = F.col("picked") - F.col("tp"), F.col("support") - F.col("tp")
    out = z.withColumns({"fp": fp, "fn": fn}).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp = F.col("tp")
    return out.withColumns(
        {
            "precision": _over(tp, tp + F.col("fp")),
            "recall": _over(tp, tp + F.col("fn")),
            "f1": _over(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
            "fpr": _over(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    ).select("class", "support", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")


def overall(pc: DataFrame) -> DataFrame:
    benign = F.col("class") == "BENIGN"
    return pc.agg(
        _over(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _over(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        _over(F.sum(F.when(benign, F.col("fn"))), F.sum(F.when(benign, F.col("support")))).alias("fpr_overall"),
    )


def binary(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Attack / benign figures from two boolean columns."""
    c = df.agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "accuracy": _over(tp + tn, tp + fp + fn + tn),
            "precision": _over(tp, tp + fp),
            "tpr": _over(tp, tp + fn),
            "f1": _over(2 * tp, 2 * tp + fp + fn),
            "fpr": _over(fp, fp + tn),
        }
    )


def detection_rates(df: DataFrame, detected: Column, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != "BENIGN").groupBy(F.col(label).alias("class")).agg(
        F.avg(detected.cast("double")).alias("rate"), F.count(F.lit(1)).alias("support")
    )


def compare_rates(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("class", F.col("rate").alias("rate_a"))
    right = b.select("class", F.col("rate").alias("rate_b"))
    return left.join(right, "class", "full").withColumn("delta", F.col("rate_a") - F.col("rate_b"))


def _one_vs_rest(df: DataFrame, probs: Column, label: str, classes: Sequence[str]) -> DataFrame:
    """(class, p, is_class) for each row and class."""
    pairs = F.arrays_zip(_classes(classes).alias("class"), probs.alias("p"))
    return df.select(F.col(label).alias("__y"), F.explode(pairs).alias("z")).select(
        F.col("z.class").alias("class"), F.col("z.p").alias("p"), (F.col("__y") == F.col("z.class")).alias("y")
    )


def _sweep(binned: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Counts at every threshold from (keys, p, y).

    A row is reduced to the number of thresholds it reaches, so the table to sweep
    has one line per key and threshold, whatever the number of rows.
    """
    ts = F.array(*[F.lit(t) for t in grid])
    reach = reduce(add, [(F.col("p") >= t).cast("int") for t in grid])
    n = binned.groupBy(*keys, reach.alias("reach")).agg(
        F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")
    )
    steps = F.posexplode(ts).alias("i", "t")
    axis = n.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).select(
        *keys, "all_pos", "all_neg", steps
    )
    joined = axis.join(n, list(keys)) if keys else axis.crossJoin(n)
    return joined.groupBy(*keys, "t", "all_pos", "all_neg").agg(
        F.coalesce(F.sum(F.when(F.col("reach") > F.col("i"), F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("reach") > F.col("i"), F.col("neg"))), F.lit(0)).alias("fp"),
    ).withColumn("f1", _over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")))


def best_thresholds(
    df: DataFrame, probs: Column, label: str = "label", grid: Sequence[float] = COARSE, classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Per class the first threshold with the best one-vs-rest F1; 0.5 if F1 is 0."""
    at = _sweep(_one_vs_rest(df, probs, label, classes), ["class"], grid)
    best = at.groupBy("class").agg(F.min(F.struct((-F.col("f1")).alias("m"), "t")).alias("b"))
    return best.select(
        "class", (-F.col("b.m")).alias("f1"), F.when(F.col("b.m") < 0, F.col("b.t")).otherwise(0.5).alias("threshold")
    )


def contamination_sweep(scored: DataFrame, offsets: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """Try each contamination offset on (raw, is_attack) rows.

    ``offsets`` (contamination, offset) is a short parameter table. For each, the
    threshold on the confidence with the best F1 is taken; feasible ones have a
    false-positive rate of at most ``max_fpr``, the winner among them the highest
    detection rate, or the lowest false-positive rate if none is feasible.
    """
    conf = scored.crossJoin(F.broadcast(offsets)).select(
        "contamination", (1.0 / (1.0 + F.exp(F.col("raw") - F.col("offset")))).alias("p"), F.col("is_attack").alias("y")
    )
    at = _sweep(conf, ["contamination"], ANOMALY_GRID)
    pick = at.groupBy("contamination").agg(
        F.min(F.struct((-F.col("f1")).alias("m"), "t", "tp", "fp", "all_pos", "all_neg")).alias("b")
    )
    out = pick.select(
        "contamination", F.col("b.t").alias("threshold"), (-F.col("b.m")).alias("f1"),
        _over(F.col("b.tp"), F.col("b.all_pos")).alias("tpr"), _over(F.col("b.fp"), F.col("b.all_neg")).alias("fpr"),
    ).withColumn("feasible", F.col("fpr") <= max_fpr)
    # first by feasibility, then detection rate (or low false positives), then order of the grid
    rank = F.struct(
        (~F.col("feasible")).cast("int").alias("a"),
        F.when(F.col("feasible"), -F.col("tpr")).otherwise(F.col("fpr")).alias("b"),
        F.col("contamination").alias("c"),
    )
    winner = out.agg(F.min_by("contamination", rank).alias("w"))
    return out.crossJoin(F.broadcast(winner)).withColumn("chosen", F.col("contamination") == F.col("w")).drop("w")


def grid_choice(results: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """Best macro F1 among rows with a low false-positive rate, else best macro F1."""
    rank = F.struct(
        (F.col("fpr") > max_fpr).cast("int").alias("a"), (-F.col("macro_f1")).alias("b"), F.col("candidate").alias("c")
    )
    winner = results.agg(F.min_by("candidate", rank).alias("w"))
    return results.crossJoin(F.broadcast(winner)).withColumn("chosen", F.col("candidate") == F.col("w")).drop("w")


# --- ROC -------------------------------------------------------------------

SLICES = 1024


def roc_points(scored: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """ROC points per key from (keys, p, y), scores in [0, 1].

    Rows collapse to distinct scores first; the running counts go over score slices,
    so a curve of any length is spread over many tasks.
    """
    keys = list(keys)
    hist = scored.groupBy(*keys, "p").agg(
        F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")
    ).withColumn("slice", F.floor(-F.col("p") * SLICES).cast("long"))
    cum = ordered.running_sum(hist, keys, "slice", [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    sizes = hist.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = cum.join(sizes, keys) if keys else cum.crossJoin(F.broadcast(sizes))
    return joined.select(
        *keys, "slice", F.col("p").alias("threshold"), "pos", "neg", "tp", "fp",
        _over(F.col("tp"), F.col("all_pos")).alias("tpr"), _over(F.col("fp"), F.col("all_neg")).alias("fpr"),
    )


def roc_auc(points: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """Area by trapezoids; each step needs only its own row."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return points.groupBy(*keys).agg(
        _over(area, F.max("tp").cast("double") * F.max("fp").cast("double")).alias("auc")
    )


def drop_collinear(points: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """Keep the corners of each curve: first, last, and every change of step."""
    keys = list(keys)
    nxt = ordered.previous(
        points.withColumn("__s", -F.col("slice")).withColumn("__o", F.col("threshold")),
        keys, "__s", ["__o"], ["__o", "pos", "neg"], "next_",
    )
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    turn = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return nxt.filter(F.col("next_pos").isNull() | turn | first).select(*points.columns)


def operating_point(points: DataFrame, target: float) -> DataFrame:
    """The ROC point whose threshold is nearest to a target (first in curve order)."""
    near = F.struct(F.abs(F.col("threshold") - target).alias("d"), (-F.col("threshold")).alias("o"))
    return points.agg(F.min_by(F.struct("threshold", "tpr", "fpr"), near).alias("x")).select("x.*")


def macro_auc(points: DataFrame, classes: int) -> DataFrame:
    """Area under the mean of the class curves, interpolated on all their FPR values.

    A range join without a join: the FPR axis and each curve are put in one order,
    and a row takes the curve point at or before it and the one after it. Slices of
    the axis keep the order local, borders come from per-slice summaries.
    """
    # each table below is read several times and is smaller than what it is made from
    points = cut_lineage(points.select("class", "fpr", "tpr"), "curves")
    origin = points.select("class").distinct().select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    curve = points.select("class", "fpr", "tpr").unionByName(origin)
    step = cut_lineage(
        curve.groupBy("class", "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi")), "steps"
    )
    axis = step.select("fpr").distinct()
    names = step.select("class").distinct()
    grid = axis.crossJoin(F.broadcast(names)).select("class", "fpr")
    both = grid.join(step, ["class", "fpr"], "left").withColumn("cut", F.floor(F.col("fpr") * SLICES).cast("long"))
    left = F.when(F.col("hi").isNotNull(), F.struct("fpr", F.col("hi").alias("t")))
    right = F.when(F.col("lo").isNotNull(), F.struct("fpr", F.col("lo").alias("t")))
    ends = both.groupBy("class", "cut").agg(F.max(left).alias("l"), F.min(right).alias("r"))
    later = Window.partitionBy("class").orderBy("cut").rowsBetween(1, Window.unboundedFollowing)
    border = ends.select(
        "class", "cut", F.max("l").over(ordered.before(["class"], "cut")).alias("l0"),
        F.first("r", True).over(later).alias("r0"),
    )
    w = Window.partitionBy("class", "cut").orderBy("fpr").rowsBetween(Window.unboundedPreceding, 0)
    d = Window.partitionBy("class", "cut").orderBy(F.col("fpr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    z = both.join(border, ["class", "cut"]).select(
        "class", "fpr", "cut", F.coalesce(F.last(left, True).over(w), F.col("l0")).alias("a"),
        F.coalesce(F.last(right, True).over(d), F.col("r0")).alias("b"),
    )
    value = F.when(F.col("b").isNull() | (F.col("fpr") == F.col("a.fpr")), F.col("a.t")).otherwise(
        F.col("a.t") + (F.col("b.t") - F.col("a.t")) * (F.col("fpr") - F.col("a.fpr")) / (F.col("b.fpr") - F.col("a.fpr"))
    )
    mean = cut_lineage(z.groupBy("fpr", "cut").agg((F.sum(value) / F.lit(classes)).alias("t")), "mean")
    back = ordered.previous(mean, [], "cut", ["fpr"], ["fpr", "t"])
    return back.filter("prev_fpr IS NOT NULL").agg(
        F.sum((F.col("fpr") - F.col("prev_fpr")) * (F.col("t") + F.col("prev_t")) / 2).alias("macro_auc")
    )


# --- targets, registry, latency, evaluation --------------------------------

# Metric, direction, limit.
TARGETS = [
    ("accuracy", ">=", 0.95), ("macro_f1", ">=", 0.95), ("fpr_overall", "<=", 0.05),
    ("macro_precision", ">=", 0.90), ("macro_recall", ">=", 0.90),
]


def assess(metrics: DataFrame, targets: Sequence[tuple[str, str, float]] = TARGETS) -> DataFrame:
    """Each target with the measured value and whether it is met."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(limit).alias("target"),
                (F.col(m) >= limit if op == ">=" else F.col(m) <= limit).alias("met"),
            )
            for m, op, limit in targets
        ]
    )
    return metrics.select(F.explode(rows).alias("r")).select("r.*")


def compare_models(results: DataFrame, ensemble: str) -> DataFrame:
    """(model, metric, value) side by side with the ensemble's lead over the best single."""
    best = results.filter(F.col("model") != ensemble).groupBy("metric").agg(
        F.max("value").alias("best_single"), F.max_by("model", F.struct("value", "model")).alias("best_model")
    )
    mine = results.filter(F.col("model") == ensemble).select("metric", F.col("value").alias("ensemble"))
    return mine.join(best, "metric").withColumn("gain", F.col("ensemble") - F.col("best_single"))


def model_registry(models: DataFrame) -> DataFrame:
    return models.orderBy("model_type", F.col("trained_us").desc(), "model_id")


def conflicting_active(models: DataFrame) -> DataFrame:
    """Model types with more than one active model."""
    return models.filter("is_active").groupBy("model_type").agg(F.count(F.lit(1)).alias("active")).filter("active > 1")


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    p = ordered.exact_percentiles(df, [], value, [0.5, 0.95, 0.99])
    m = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))
    return p.crossJoin(m)


def recent(df: DataFrame, order: str, n: int = 1000) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def latency_cdf(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share at each distinct value."""
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).withColumn("cut", ordered.value_chunk(F.col(value)))
    cum = ordered.running_sum(hist, [], "cut", [value], {"cum": F.col("n")})
    total = hist.agg(F.sum("n").alias("t"))
    return cum.crossJoin(F.broadcast(total)).select(value, (F.col("cum") / F.col("t")).alias("share"))


def evaluate_alerts(truth: DataFrame, alerts: DataFrame) -> DataFrame:
    """Ground truth (flow_id, label) with the class alerted for the flow, else BENIGN."""
    last = alerts.groupBy("flow_id").agg(F.max_by("attack_type", F.struct("t_us", "alert_id")).alias("pred"))
    joined = truth.select("flow_id", "label").join(last, "flow_id", "left")
    return joined.withColumn("pred", F.coalesce("pred", F.lit("BENIGN")))


def alert_scores(joined: DataFrame) -> DataFrame:
    """Per attack class: any alert counts as found; precision has no class term."""
    hit = F.col("pred") != "BENIGN"
    t = joined.filter("label <> 'BENIGN'").groupBy(F.col("label").alias("class")).agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn")
    )
    tpr = _over(F.col("tp"), F.col("tp") + F.col("fn"))
    prec = F.when(F.col("tp") > 0, 1.0).otherwise(0.0)
    return t.withColumns({"tpr": F.round(tpr, 3), "precision": prec, "f1": F.round(_over(2 * prec * tpr, prec + tpr), 3)})


def alert_summary(joined: DataFrame, min_f1: float = 0.95, max_fpr: float = 0.05) -> DataFrame:
    """Mean F1 over attack classes, false-positive rate, support-weighted F1, verdicts."""
    mean = alert_scores(joined).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("mean_f1"))
    benign = joined.filter("label = 'BENIGN'").agg(
        _over(F.count_if(F.col("pred") != "BENIGN"), F.count(F.lit(1))).alias("fpr")
    )
    weighted = overall(per_class(confusion(joined))).select("weighted_f1")
    return mean.crossJoin(benign).crossJoin(weighted).withColumns(
        {"f1_pass": F.col("mean_f1") >= min_f1, "fpr_pass": F.col("fpr") <= max_fpr}
    )
