"""From packets through trained models to alerts, on flows that no model has seen in training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts, correlate, ensemble, metrics, models, ordered, prep
from tidewatch.plans import detection_queries as dq
from tidewatch.plans import verdict_queries as vq
from tidewatch.plans.catalog import register
from tidewatch.plans.model_queries import FEATURES, LABEL
from tidewatch.session import cut_lineage

CONTAMINATION = 0.01
DAY_US = 86_400_000_000


def scored(spark, sf, trees: int = 200, rounds: int = 50, tree_count: int = models.TREES) -> DataFrame:
    """The test flows with the signature result and what each trained model says of them.

    The forest and the sequence network learn from all classes of the training flows, the anomaly
    forest from the benign ones. The network sees a flow's last ten vectors from its source; until there
    are ten it is silent.
    """
    flows = dq.signed(spark, sf).withColumn("label", F.expr(LABEL))
    split = cut_lineage(prep.stratified_split(flows, "flow_id"), "trained-split")
    s = prep.scale(split, prep.minmax(split.filter("NOT is_test"), FEATURES), FEATURES)
    s = cut_lineage(s.withColumn("chunk", ordered.time_chunk("start_us", DAY_US)), "trained-flows")
    train, test = s.filter("NOT is_test"), s.filter("is_test")
    vec, order = F.array(*[F.col(c).cast("double") for c in FEATURES]), ["start_us", "flow_id"]

    forest = models.train_forest(train, FEATURES, trees)
    rf = models.forest_probabilities(forest, test, FEATURES).withColumnRenamed("probabilities", "rf_probs")

    sequences = cut_lineage(prep.sequences(train, "label", "chunk", order, vec), "trained-sequences")
    net = models.train_sequence_classifier(sequences, prep.WINDOW * len(FEATURES), rounds=rounds)
    seen = prep.source_windows(s.select("src_ip", "chunk", "start_us", "flow_id", "is_test", *FEATURES), "src_ip", "chunk", order, vec)
    full = seen.filter("is_test AND window_complete").select("flow_id", F.col("recent").alias("items"))
    lstm = models.sequence_probabilities(net, full).select("flow_id", F.col("probabilities").alias("lstm_probs"))

    benign = train.filter("label = 'BENIGN'")
    grown = cut_lineage(models.train_anomaly_forest(benign, FEATURES, "flow_id", tree_count), "trained-trees")
    usual = cut_lineage(models.anomaly_scores(s.filter("is_test OR label = 'BENIGN'"), grown, FEATURES).select("flow_id", "is_test", "sample_score"), "trained-scores")
    offset = models.contamination_offsets(usual.filter("NOT is_test"), [CONTAMINATION])
    strange = models.decision(usual.filter("is_test"), offset).select("flow_id", "raw_score")
    return cut_lineage(rf.join(lstm, "flow_id", "left").join(strange, "flow_id", "left"), "trained-scored")


def voted(rows: DataFrame) -> DataFrame:
    """The verdict on each flow: three models and the signatures vote."""

    def said(probs: str) -> tuple[Column, Column, Column]:
        name, conf = metrics.predict_argmax(F.col(probs))
        return name, F.when(name != "BENIGN", conf).otherwise(F.lit(0.0)), name != "BENIGN"

    both = ensemble.attached(rows, said("rf_probs"), said("lstm_probs"), metrics.anomaly_gate(F.col("raw_score"), 0.0), F.col("lstm_probs").isNotNull())
    return ensemble.verdicts(both)


TEST_SQL = f"""{dq.SIGNED_SQL}, labelled AS (SELECT *, {LABEL} AS label FROM signed),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(flow_id), flow_id) AS place, count(*) OVER (PARTITION BY label) AS n,
 count(*) OVER (PARTITION BY src_ip ORDER BY start_us, flow_id) >= {prep.WINDOW} AS warm FROM labelled),
test AS (SELECT * FROM placed WHERE place <= ceil(n * 0.2e0))"""


@register(
    "detect_trained_scores",
    f"""WITH {TEST_SQL} SELECT flow_id, label, sig_type, warm AS window_complete, 1e0 AS rf_sum, CASE WHEN warm THEN 1e0 END AS lstm_sum,
 {len(prep.CLASSES)}::INT AS classes, TRUE AS rf_says_greatest, TRUE AS is_vote, TRUE AS is_gated, TRUE AS has_anomaly_score FROM test""",
)
def trained_scores(spark, sf, **sizes):
    """Every test flow once, with what must hold whatever the models have learned: probabilities over all classes that sum to
    one, the greatest one's class, the weighted vote, the gate and its severity."""
    out = voted(scored(spark, sf, **sizes))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    w, f = ensemble.WEIGHTS, F.col
    vote = F.when(f("sig_matched"), w["sig"]).otherwise(0.0) + w["rf"] * f("rf_conf") + w["lstm"] * f("lstm_conf") + w["if"] * f("if_conf")
    greatest = F.array_max("rf_probs")
    says = F.element_at("rf_probs", (F.array_position(F.array(*map(F.lit, prep.CLASSES)), f("rf_type"))).cast("int")) == greatest
    floor = F.when(~f("alert"), "NONE").when(f("score") >= 0.95, "CRITICAL").when(f("score") >= 0.85, "HIGH").when(f("score") >= 0.70, "MEDIUM").otherwise("LOW")
    return out.select(
        "flow_id", "label", "sig_type", "window_complete", total("rf_probs").alias("rf_sum"), total("lstm_probs").alias("lstm_sum"), F.size("rf_probs").alias("classes"),
        (says & f("rf_conf").eqNullSafe(F.when(f("rf_type") != "BENIGN", greatest).otherwise(0.0))).alias("rf_says_greatest"),
        (F.abs(f("score") - F.least(vote, F.lit(1.0))) < 1e-6).alias("is_vote"),
        ((f("alert") == (f("score") >= ensemble.ALERT_AT)) & (f("severity") == floor)).alias("is_gated"),
        (f("raw_score").isNotNull() & (f("is_anomaly") == (f("raw_score") < 0))).alias("has_anomaly_score"),
    )


@register(
    "detect_trained_alerts",
    "SELECT TRUE AS all_accounted, TRUE AS alerts_once, TRUE AS groups_in_time, TRUE AS some_learned",
)
def trained_alerts(spark, sf, **sizes):
    """The alerts of the trained models, held against the verdicts they come from: each gated flow stands in one alert or among
    its duplicates, an alert comes once, a group lasts as long as it may, and most test flows are told their class."""
    rows = cut_lineage(voted(scored(spark, sf, **sizes)), "trained-verdicts")
    events = rows.filter("alert").select(
        F.col("first_packet_id").alias("event_id"), "flow_id", F.col("start_us").alias("t_us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "attack_type", "severity", F.col("score").alias("confidence"), "detected_by",
    )
    out = cut_lineage(alerts.build_alerts(correlate.correlate(cut_lineage(events, "trained-events"), vq.DEDUP, vq.SHORT_GROUP)), "trained-alerts")
    spans = events.select("flow_id", "t_us").join(out.select("flow_id", "group_id"), "flow_id").groupBy("group_id").agg((F.max("t_us") - F.min("t_us")).alias("span"))
    a = out.agg(F.sum(F.col("dup_count") + 1).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_distinct("alert_id").alias("ids"))
    e = events.agg(F.count(F.lit(1)).alias("events"))
    g = spans.agg(F.max("span").alias("longest"))
    name, _ = metrics.predict_argmax(F.col("rf_probs"))
    h = rows.agg(F.avg((name == F.col("label")).cast("double")).alias("right"))
    one = a.join(e).join(g).join(h)  # one row each
    return one.select(
        (F.coalesce("n", F.lit(0)) == F.col("events")).alias("all_accounted"), (F.col("rows") == F.col("ids")).alias("alerts_once"),
        F.coalesce(F.col("longest") <= vq.SHORT_GROUP, F.lit(True)).alias("groups_in_time"), (F.col("right") > 0.5).alias("some_learned"),
    )
