"""Model training and scoring over flows built from the given tables (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import flows, metrics, models, ordered, prep
from tidewatch.plans.catalog import register
from tidewatch.plans.flow_queries import flow_table
from tidewatch.session import cut_lineage

FEATURES = flows.FEATURES
# a label the features can explain, so that quality figures mean something
LABEL = """CASE WHEN rst_flag_count > 0 THEN 'Infiltration' WHEN fin_flag_count > 0 THEN 'WebAttack' WHEN syn_flag_count > 0 THEN 'DoS'
 WHEN psh_flag_count > 0 THEN 'PortScan' WHEN protocol = 'UDP' THEN 'Botnet' ELSE 'BENIGN' END"""


def labelled_flows(spark, sf):
    """Flows with label, split mark and scaled features, written once: training reads
    the rows many times."""
    f = flow_table(spark, sf).withColumn("label", F.expr(LABEL))
    cols = ["flow_id", "src_ip", "start_us", "label", *FEATURES]
    s = cut_lineage(prep.stratified_split(f.select(*cols), "flow_id"), "split")  # read for the bounds and for the rows
    s = prep.scale(s, prep.minmax(s.filter("NOT is_test"), FEATURES), FEATURES)
    return cut_lineage(s, "flows")


def validation(train):
    """Training rows, a fifth of each class marked for validation."""
    return prep.stratified_split(train.withColumn("k", F.concat(F.lit("v"), "flow_id")), "k", out="is_valid")


@register("ml_random_forest")
def random_forest(spark, sf):
    s = labelled_flows(spark, sf)
    model = models.train_forest(s.filter("NOT is_test"), FEATURES)
    out = models.forest_probabilities(model, s.filter("is_test"), FEATURES)
    name, conf = metrics.predict_argmax(F.col("probabilities"))
    return out.select("flow_id", "label", name.alias("pred"), conf.alias("confidence"))


def searched(v):
    """The twelve candidates on a fifth of the training rows, the winner by the validation rows marked."""
    train = v.filter("NOT is_valid").drop("k", "is_valid")
    sub = prep.stratified_split(train.withColumn("k", F.concat(F.lit("s"), "flow_id")), "k", out="chosen")
    # each candidate reads its rows several times; without this every reading splits all training rows anew
    sub = cut_lineage(sub.filter("chosen").drop("chosen", "k"), "search")
    return models.grid_search(sub, v.filter("is_valid"), FEATURES)


@register("ml_random_forest_tuned")
def random_forest_tuned(spark, sf):
    """Search, refit the winner on all training rows, calibrate thresholds on the validation rows among them, score the test rows."""
    s = labelled_flows(spark, sf)
    v = cut_lineage(validation(s.filter("NOT is_test")), "validation")
    model = models.refit_winner(searched(v), v, FEATURES)
    valid = models.forest_probabilities(model, v.filter("is_valid"), FEATURES)
    best = {r["class"]: r["threshold"] for r in metrics.best_thresholds(valid, F.col("probabilities")).collect()}
    test = models.forest_probabilities(model, s.filter("is_test"), FEATURES)
    name, _ = metrics.predict_thresholds(F.col("probabilities"), [best[c] for c in prep.CLASSES])
    cm = metrics.confusion(test.withColumn("pred", name))
    return metrics.overall(metrics.per_class(cm))


@register("ml_grid_search")
def grid_search(spark, sf):
    """The candidates of the search; ml_random_forest_tuned refits the winner."""
    return searched(cut_lineage(validation(labelled_flows(spark, sf).filter("NOT is_test")), "validation"))


def _anomaly(spark, sf):
    """Scores of all flows by a forest grown on benign training rows; validation rows are apart."""
    s = labelled_flows(spark, sf)
    held = validation(s.filter("NOT is_test")).filter("is_valid").select("flow_id", F.lit(True).alias("is_valid"))
    s = cut_lineage(s.join(held, "flow_id", "left").na.fill(False, ["is_valid"]), "marked")
    benign = s.filter("NOT is_test AND NOT is_valid AND label = 'BENIGN'")
    forest = models.train_anomaly_forest(benign, FEATURES, "flow_id")
    forest = cut_lineage(forest, "trees")
    scored = models.anomaly_scores(s, forest, FEATURES)
    return cut_lineage(scored.select("flow_id", "label", "is_test", "is_valid", "sample_score"), "scores")


@register("ml_anomaly_forest")
def anomaly_forest(spark, sf):
    scored = _anomaly(spark, sf)
    offset = models.contamination_offsets(scored.filter("NOT is_test AND NOT is_valid AND label = 'BENIGN'"), [0.01])
    raw = models.decision(scored.filter("is_test"), offset)
    flag, conf = metrics.anomaly_gate(F.col("raw_score"), 0.0)
    return raw.select("flow_id", "label", "raw_score", flag.alias("is_anomaly"), conf.alias("confidence"))


@register("ml_anomaly_tuning")
def anomaly_tuning(spark, sf):
    scored = _anomaly(spark, sf)
    offsets = models.contamination_offsets(
        scored.filter("NOT is_test AND NOT is_valid AND label = 'BENIGN'"), [0.005, 0.008, 0.01, 0.015, 0.02]
    )
    valid = scored.filter("is_valid").select(
        F.col("sample_score").alias("raw"), (F.col("label") != "BENIGN").alias("is_attack")
    )
    return metrics.contamination_sweep(valid, offsets)


@register("ml_sequence_classifier")
def sequence_classifier(spark, sf):
    s = labelled_flows(spark, sf).withColumn("chunk", ordered.time_chunk("start_us", 86_400_000_000))
    vec = F.array(*FEATURES)
    train = prep.sequences(s.filter("NOT is_test"), "label", "chunk", ["start_us", "flow_id"], vec)
    test = prep.sequences(s.filter("is_test"), "label", "chunk", ["start_us", "flow_id"], vec, stride=10)
    train = cut_lineage(train, "sequences")
    model = models.train_sequence_classifier(train, prep.WINDOW * len(FEATURES))
    out = models.sequence_probabilities(model, test)
    name, conf = metrics.predict_argmax(F.col("probabilities"))
    return out.select("label", "start", name.alias("pred"), conf.alias("confidence"))
