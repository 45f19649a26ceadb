"""Weighted vote over four engines, one row per flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"sig": 0.40, "rf": 0.35, "lstm": 0.15, "if": 0.10}
ALERT_AT = 0.50
SEVERITY_FLOORS = [("CRITICAL", 0.95), ("HIGH", 0.85), ("MEDIUM", 0.70)]


def combine(
    flows: DataFrame, sig: DataFrame, rf: DataFrame, lstm: DataFrame, iforest: DataFrame
) -> DataFrame:
    """Left-join the engine tables on flow_id; a missing engine is neutral."""
    s = sig.select("flow_id", F.col("matched").alias("sig_matched"), "rule_id",
                   F.col("attack_type").alias("sig_type"), F.col("confidence").alias("sig_conf"))
    r = rf.select("flow_id", F.col("predicted_class").alias("rf_type"), F.col("confidence").alias("rf_conf"),
                  F.col("is_attack").alias("rf_attack"))
    q = lstm.select("flow_id", F.col("predicted_class").alias("lstm_type"), F.col("confidence").alias("lstm_conf"),
                    F.col("is_attack").alias("lstm_attack"), "window_complete")
    i = iforest.select("flow_id", "is_anomaly", F.col("confidence").alias("if_conf"))
    out = flows
    for t in (s, r, q, i):
        out = out.join(t, "flow_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("sig_conf", "rf_conf", "lstm_conf", "if_conf")}
    no = {
        c: F.coalesce(c, F.lit(False))
        for c in ("sig_matched", "rf_attack", "lstm_attack", "window_complete", "is_anomaly")
    }
    benign = {c: F.coalesce(c, F.lit("BENIGN")) for c in ("sig_type", "rf_type", "lstm_type")}
    return out.withColumns({**zero, **no, **benign})


def attached(
    signed: DataFrame, rf: tuple[Column, Column, Column], lstm: tuple[Column, Column, Column],
    iforest: tuple[Column, Column], window_complete: Column,
) -> DataFrame:
    """The columns of ``combine`` for models whose results stand on the flow row: no join.

    ``rf`` and ``lstm`` are (predicted class, confidence, is attack), ``iforest`` is (is
    anomaly, confidence); a NULL is neutral. ``signed`` has the signature result.
    """
    zero, no, benign = F.lit(0.0), F.lit(False), F.lit("BENIGN")
    out = {"sig_matched": F.col("matched"), "sig_conf": F.col("sig_confidence"), "window_complete": F.coalesce(window_complete, no)}
    for name, (kind, conf, attack) in (("rf", rf), ("lstm", lstm)):
        out |= {f"{name}_type": F.coalesce(kind, benign), f"{name}_conf": F.coalesce(conf, zero), f"{name}_attack": F.coalesce(attack, no)}
    return signed.withColumns(out | {"is_anomaly": F.coalesce(iforest[0], no), "if_conf": F.coalesce(iforest[1], zero)})


def score(sig: Column, rf: Column, lstm: Column, iforest: Column, weights: dict = WEIGHTS) -> Column:
    if abs(sum(weights.values()) - 1.0) >= 1e-9:
        raise ValueError("ensemble weights must sum to 1")
    total = sig * weights["sig"] + rf * weights["rf"] + lstm * weights["lstm"] + iforest * weights["if"]
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6)


def severity(value: Column) -> Column:
    out = F.lit("LOW")
    for name, floor in reversed(SEVERITY_FLOORS):
        out = F.when(value >= floor, name).otherwise(out)
    return out


def _present(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def verdicts(combined: DataFrame, weights: dict = WEIGHTS, threshold: float = ALERT_AT) -> DataFrame:
    """Score, alert gate, severity, attack type, contributing engines, detected_by."""
    warm = F.when(F.col("window_complete"), F.col("lstm_conf")).otherwise(F.lit(0.0))
    lstm_hit = F.col("lstm_attack") & (F.col("lstm_conf") > 0)
    engines = _present(
        (F.col("sig_matched"), "signature"), (F.col("rf_attack"), "rf"),
        (lstm_hit, "lstm"), (F.col("is_anomaly"), "isolation_forest"),
    )
    kind = (
        F.when(F.col("sig_matched"), F.col("sig_type"))
        .when(F.col("rf_attack"), F.col("rf_type"))
        .when(lstm_hit, F.col("lstm_type"))
        .when(F.col("is_anomaly"), "ANOMALY")
        .otherwise("BENIGN")
    )
    by = (
        F.when(F.size("contributing_engines") == 0, "none")
        .when(F.col("sig_matched") & (F.size("contributing_engines") > 1), "both")
        .when(F.col("sig_matched"), "signature")
        .otherwise("ml")
    )
    return (
        combined.withColumn("lstm_conf", warm)
        .withColumn("score", score(F.col("sig_conf"), F.col("rf_conf"), F.col("lstm_conf"), F.col("if_conf"), weights))
        .withColumn("alert", F.col("score") >= threshold)
        .withColumn("severity", F.when(F.col("alert"), severity(F.col("score"))).otherwise("NONE"))
        .withColumn("attack_type", kind)
        .withColumn("contributing_engines", engines)
        .withColumn("detected_by", by)
    )


def connector_verdicts(df: DataFrame) -> DataFrame:
    """Variant over nullable confidences and types: score to 4 places, type from the
    first engine with a positive non-benign result, else UNKNOWN."""
    conf = {e: F.coalesce(f"{e}_conf", F.lit(0.0)) for e in ("sig", "rf", "lstm", "if")}
    raw = sum((conf[e] * w for e, w in list(WEIGHTS.items())[1:]), conf["sig"] * WEIGHTS["sig"])
    kind = {e: F.coalesce(F.col(f"{e}_type"), F.lit("BENIGN")) for e in ("sig", "rf", "lstm")}
    kind["if"] = F.lit("ANOMALY")
    on = {e: (conf[e] > 0) & (kind[e] != "BENIGN") for e in conf}
    names = {"sig": "signature", "rf": "rf", "lstm": "lstm", "if": "if"}
    hits = _present(*[(on[e], names[e]) for e in on])
    first_kind = F.when(on["sig"], kind["sig"]).when(on["rf"], kind["rf"]).when(on["lstm"], kind["lstm"]).when(
        on["if"], kind["if"]
    ).otherwise("UNKNOWN")
    by = F.when(F.size(hits) == 0, "ml").when(on["sig"] & (F.size(hits) > 1), "both").otherwise(
        F.try_element_at(hits, F.lit(1))
    )
    return df.withColumns(
        {"ensemble_score": F.round(raw + 1e-9, 4), "attack_type": first_kind, "detected_by": by,
         "severity": severity(F.round(raw, 6))}
    )


def method_verdicts(df: DataFrame, threshold: float = ALERT_AT) -> DataFrame:
    """Variant that names the method: HYBRID with a signature, else ENSEMBLE."""
    s = F.round(
        F.col("sig_conf") * 0.40 + F.col("rf_conf") * 0.35 + F.col("lstm_conf") * 0.15 + F.col("if_conf") * 0.10, 6
    )
    return (
        df.withColumn("ensemble_score", s)
        .filter(F.col("ensemble_score") >= threshold)
        .withColumn(
            "detection_method",
            F.when(F.col("sig_matched") | (F.col("sig_conf") > 0), "HYBRID").otherwise("ENSEMBLE"),
        )
        .withColumn("attack_type", F.when(F.coalesce("sig_type", F.lit("BENIGN")) != "BENIGN", F.col("sig_type")).otherwise(F.col("rf_type")))
    )


def ml_partial(df: DataFrame) -> DataFrame:
    """Score and type from the three models alone; a cold or late sequence model counts 0."""
    ready = ~F.col("cold_start") & ~F.col("timed_out")
    lstm = F.when(ready, F.coalesce("lstm_conf", F.lit(0.0))).otherwise(0.0)
    part = F.coalesce("rf_conf", F.lit(0.0)) * 0.35 + lstm * 0.15 + F.coalesce("if_conf", F.lit(0.0)) * 0.10
    kind = (
        F.when(F.coalesce("rf_attack", F.lit(False)), F.col("rf_type"))
        .when(F.coalesce("lstm_attack", F.lit(False)) & ~F.col("cold_start"), F.col("lstm_type"))
        .when(F.coalesce("is_anomaly", F.lit(False)), "ANOMALY")
        .otherwise("BENIGN")
    )
    return df.withColumns({"ml_score": F.round(part, 6), "ml_type": kind})
