"""Feature preparation and metric queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import metrics, ordered, prep
from tidewatch.plans import adapters as ad
from tidewatch.plans.catalog import r, register, rounded
from tidewatch.session import cut_lineage

X = ["x0", "x1", "x2"]
L = ad.cte("labelled")
P = ad.cte("predictions")
CL = prep.CLASSES
PS = [f"p{i}" for i in range(8)]



def probs():
    return F.array(*PS)


LABEL_SQL = """CASE trim(raw_label) WHEN 'BENIGN' THEN 'BENIGN' WHEN 'DoS Hulk' THEN 'DoS' WHEN 'DoS slowloris' THEN 'DoS' WHEN 'Heartbleed' THEN 'DoS'
 WHEN 'DDoS' THEN 'DDoS' WHEN 'PortScan' THEN 'PortScan' WHEN 'FTP-Patator' THEN 'BruteForce' WHEN 'SSH-Patator' THEN 'BruteForce' WHEN 'Bot' THEN 'Botnet'
 WHEN 'Infiltration' THEN 'Infiltration' ELSE CASE WHEN regexp_matches(lower(raw_label), 'brute|xss|sql|web') THEN 'WebAttack' ELSE 'BENIGN' END END"""
LAB = f"{L}, lab AS (SELECT *, {LABEL_SQL} AS label FROM labelled)"
FIX = f"""{LAB}, fin AS (SELECT * REPLACE ({", ".join(f"CASE WHEN isfinite({x}) THEN {x} END AS {x}" for x in X)}) FROM lab),
fixed AS (SELECT pos, file, label, {", ".join(f"coalesce({x}, max({x}) OVER (PARTITION BY file), 0)::FLOAT AS {x}" for x in X)} FROM fin)"""
SPLIT = f"""{FIX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(pos::VARCHAR), pos) AS rn, count(*) OVER (PARTITION BY label) AS n FROM fixed),
split AS (SELECT *, rn <= ceil(n * 0.2) AS is_test FROM ranked)"""
SCALED = f"""{SPLIT}, b AS (SELECT {", ".join(f"min({x})::DOUBLE AS {x}_lo, max({x})::DOUBLE AS {x}_hi" for x in X)} FROM split WHERE NOT is_test),
scaled AS (SELECT pos, label, is_test, {", ".join(f"({x}::DOUBLE - {x}_lo) / CASE WHEN {x}_hi = {x}_lo THEN 1 ELSE {x}_hi - {x}_lo END AS {x}" for x in X)} FROM split, b)"""


def labelled(spark, sf):
    return ad.load(spark, sf, "labelled").withColumn("label", prep.class_label(F.col("raw_label")))


def fixed(spark, sf):
    return prep.repair(labelled(spark, sf), X).drop("raw_label")


def split(spark, sf):
    return prep.stratified_split(fixed(spark, sf), "pos")


def scaled(spark, sf):
    s = cut_lineage(split(spark, sf), "split")  # read for the bounds and for the rows
    return prep.scale(s, prep.minmax(s.filter("NOT is_test"), X), X)


def predictions(spark, sf):
    return ad.load(spark, sf, "predictions")


@register("ml_class_label", f"WITH {LAB} SELECT pos, label FROM lab")
def class_label(spark, sf):
    return labelled(spark, sf).select("pos", "label")


@register("ml_repair", f"WITH {FIX} SELECT pos, {', '.join(r(f'{x}::DOUBLE', x) for x in X)} FROM fixed")
def repair(spark, sf):
    d = fixed(spark, sf).select("pos", *[F.col(x).cast("double").alias(x) for x in X])
    return rounded(d)


@register(
    "ml_concat_files",
    f"WITH {L} SELECT file, count(*) AS n, count(x1) AS known FROM labelled GROUP BY file",
)
def concat_files(spark, sf):
    d = ad.load(spark, sf, "labelled")
    parts = [d.filter(F.col("file") == f"day{i}") for i in range(5)]
    whole = prep.concat_files([parts[0], parts[1], parts[2], parts[3].drop("x1"), parts[4]])
    return whole.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("x1").alias("known"))


@register(
    "ml_encode_labels",
    f"WITH {LAB}, c AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_index FROM (SELECT DISTINCT label FROM lab)) SELECT pos, label, label_index FROM lab JOIN c USING (label)",
)
def encode(spark, sf):
    return prep.encode_labels(labelled(spark, sf)).select("pos", "label", "label_index")


@register(
    "ml_decode_labels",
    f"WITH {L} SELECT pos, CASE pos % 10 {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(CL))} ELSE 'UNKNOWN_' || pos % 10 END AS label FROM labelled",
)
def decode(spark, sf):
    return ad.load(spark, sf, "labelled").select("pos", prep.decode_label(F.col("pos") % 10).alias("label"))


@register("ml_stratified_split", f"WITH {SPLIT} SELECT pos, label, is_test FROM split")
def stratified_split(spark, sf):
    return split(spark, sf).select("pos", "label", "is_test")


@register("ml_minmax_scale", f"WITH {SCALED} SELECT pos, {', '.join(r(x) for x in X)} FROM scaled")
def minmax(spark, sf):
    return rounded(scaled(spark, sf).select("pos", *X))


@register(
    "ml_class_distribution",
    f"WITH {LAB} SELECT label, count(*) AS n, {r('count(*) * 100 / sum(count(*)) OVER ()', 'percent')} FROM lab GROUP BY label",
)
def class_distribution(spark, sf):
    return rounded(prep.class_distribution(labelled(spark, sf)))


_CUSTOM = " ".join(f"WHEN '{k}' THEN {v}" for k, v in prep.CUSTOM_WEIGHTS.items())
_CAPS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in prep.WEIGHT_CAPS.items())


@register(
    "ml_class_weights",
    f"""WITH {LAB}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS t, count(*) OVER () AS k, max(CASE WHEN label = 'BENIGN' THEN n END) OVER () AS b FROM c)
SELECT label, n, {r("t / (k * n)", "balanced")}, {r(f"CASE label {_CUSTOM} END", "custom")}, {r(f"least(b / n, coalesce(CASE label {_CAPS} END, b / n))", "capped")} FROM t""",
)
def class_weights(spark, sf):
    return rounded(prep.class_weights(labelled(spark, sf)))


def _seq_sql(stride):
    return f"""WITH {LAB}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS rn FROM lab),
w AS (SELECT label, rn AS start, list(pos) OVER f AS items FROM o WINDOW f AS (PARTITION BY label ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT label, start, array_to_string(items, ',') AS items FROM w WHERE start % {stride} = 0 AND len(items) = 10"""


def _sequences(spark, sf, stride):
    d = labelled(spark, sf).withColumn("chunk", F.floor(F.col("pos") / 1000))
    s = prep.sequences(d, "label", "chunk", ["pos"], F.col("pos"), stride=stride)
    return s.select("label", "start", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@register("ml_train_sequences", _seq_sql(5))
def train_sequences(spark, sf):
    return _sequences(spark, sf, 5)


@register("ml_test_sequences", _seq_sql(10))
def test_sequences(spark, sf):
    return _sequences(spark, sf, 10)


@register(
    "ml_sequence_stats",
    f"WITH {LAB} SELECT label, count(*) AS rows, CASE WHEN count(*) < 10 THEN 0 ELSE (count(*) - 10) // 5 + 1 END AS sequences, count(*) < 10 AS skipped FROM lab GROUP BY 1",
)
def sequence_stats(spark, sf):
    return prep.sequence_stats(labelled(spark, sf), "label")


@register(
    "ml_source_windows",
    f"""WITH {ad.cte("scores")}, w AS (SELECT event_id, list(event_id) OVER (PARTITION BY src_ip ORDER BY t_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM scores)
SELECT event_id, array_to_string(l, ',') AS recent, len(l) = 10 AS window_complete FROM w""",
)
def source_windows(spark, sf):
    s = ad.load(spark, sf, "scores").withColumn("chunk", ordered.time_chunk("t_us", 86_400_000_000))
    w = prep.source_windows(s, "src_ip", "chunk", ["t_us", "event_id"], F.col("event_id"))
    return w.select(
        "event_id", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"), "window_complete"
    )


@register(
    "ml_guard",
    f"WITH {P} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'zero_vector' WHEN 1 THEN 'wrong_shape' WHEN 2 THEN 'zero_vector' END AS error FROM predictions",
)
def guard(spark, sf):
    v = F.when(F.col("event_id") % 6 == 0, F.lit(None)).when(F.col("event_id") % 6 == 1, F.array("p0", "p1")).when(
        F.col("event_id") % 6 == 2, F.array_repeat(F.lit(0.0), 8)
    ).otherwise(F.array_append(F.slice(probs(), 1, 7), F.lit(0.5)))
    return predictions(spark, sf).select("event_id", prep.guard(v, 8).alias("error"))


ARR = f"[{', '.join(PS)}]"
NAMES = "[" + ", ".join(f"'{c}'" for c in CL) + "]"
THRESHOLDS = [0.5, 0.6, 0.7, 0.55, 0.65, 0.9, 0.8, 0.45]


@register(
    "ml_predict_argmax",
    f"WITH {P} SELECT event_id, {NAMES}[list_position({ARR}, list_max({ARR}))] AS pred, {r(f'list_max({ARR})', 'confidence')} FROM predictions",
)
def argmax(spark, sf):
    name, conf = metrics.predict_argmax(probs())
    return rounded(predictions(spark, sf).select("event_id", name.alias("pred"), conf.alias("confidence")))


_GAPS = "[" + ", ".join(f"{p} - {t}e0" for p, t in zip(PS, THRESHOLDS)) + "]"


@register(
    "ml_predict_thresholds",
    f"""WITH {P}, g AS (SELECT event_id, {ARR} AS p, {_GAPS} AS gaps FROM predictions), b AS (SELECT *, list_position(gaps, list_max(gaps)) AS i, list_max(gaps) <= 0 AS none FROM g)
SELECT event_id, CASE WHEN none THEN 'BENIGN' ELSE {NAMES}[i] END AS pred, {r("CASE WHEN none OR i = 1 THEN 0 ELSE p[i] END", "confidence")} FROM b""",
)
def thresholds(spark, sf):
    name, conf = metrics.predict_thresholds(probs(), THRESHOLDS)
    return rounded(predictions(spark, sf).select("event_id", name.alias("pred"), conf.alias("confidence")))


@register("ml_anomaly_gate", f"WITH {P} SELECT event_id, raw_score < 0.1135e0 AS is_anomaly, {r('1 / (1 + exp(raw_score))', 'confidence')} FROM predictions")
def anomaly_gate(spark, sf):
    flag, conf = metrics.anomaly_gate(F.col("raw_score"))
    return rounded(predictions(spark, sf).select("event_id", flag.alias("is_anomaly"), conf.alias("confidence")))


@register("ml_confusion", f"WITH {P} SELECT label, pred, count(*) AS n FROM predictions GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf))


_WIDE = ", ".join(f"count(*) FILTER (pred = '{c}') AS {c}" for c in CL)


@register("ml_confusion_wide", f"WITH {P} SELECT label, {_WIDE} FROM predictions GROUP BY label")
def confusion_wide(spark, sf):
    return metrics.confusion_wide(metrics.confusion(predictions(spark, sf)))


PC = f"""{P}, axis AS (SELECT unnest({NAMES}) AS class), cnt AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (label = class AND pred = class) AS tp,
 count(*) FILTER (label <> class AND pred = class) AS fp, count(*) FILTER (label = class AND pred <> class) AS fn, count(*) FILTER (label <> class AND pred <> class) AS tn FROM axis, predictions GROUP BY class),
pc AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM cnt)"""
ALL = f"""{PC}, total AS (SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
 sum(f1 * support) / sum(support) AS weighted_f1, sum(fn) FILTER (class = 'BENIGN') / sum(support) FILTER (class = 'BENIGN') AS fpr_overall FROM pc)"""
TOTALS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "fpr_overall"]


def per_class(spark, sf):
    return metrics.per_class(confusion(spark, sf))


@register("ml_per_class", f"WITH {PC} SELECT class, support, tp, fp, fn, tn, {r('precision')}, {r('recall')}, {r('f1')}, {r('fpr')} FROM pc")
def ml_per_class(spark, sf):
    return rounded(per_class(spark, sf))


@register("ml_overall", f"WITH {ALL} SELECT {', '.join(r(c) for c in TOTALS)} FROM total")
def ml_overall(spark, sf):
    return rounded(metrics.overall(per_class(spark, sf)))


@register(
    "ml_binary",
    f"""WITH {P}, c AS (SELECT count(*) FILTER (y AND g) AS tp, count(*) FILTER (NOT y AND g) AS fp, count(*) FILTER (y AND NOT g) AS fn, count(*) FILTER (NOT y AND NOT g) AS tn
 FROM (SELECT label <> 'BENIGN' AS y, raw_score < 0.1135e0 AS g FROM predictions))
SELECT *, {r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")}, {r("tp / (tp + fp)", "precision")}, {r("tp / (tp + fn)", "tpr")}, {r("2 * tp / (2 * tp + fp + fn)", "f1")}, {r("fp / (fp + tn)", "fpr")} FROM c""",
)
def binary(spark, sf):
    return rounded(metrics.binary(predictions(spark, sf), F.col("label") != "BENIGN", F.col("raw_score") < 0.1135))


RATES = "SELECT label AS class, avg(({0})::INT) AS rate, count(*) AS support FROM predictions WHERE label <> 'BENIGN' GROUP BY 1"


@register("ml_detection_rates", f"WITH {P}, d AS ({RATES.format('raw_score < 0.1135e0')}) SELECT class, {r('rate')}, support FROM d")
def detection_rates(spark, sf):
    return rounded(metrics.detection_rates(predictions(spark, sf), F.col("raw_score") < 0.1135))


@register(
    "ml_compare_rates",
    f"""WITH {P}, a AS ({RATES.format("pred = label")}), b AS ({RATES.format("raw_score < 0.1135e0")})
SELECT class, {r("a.rate", "rate_a")}, {r("b.rate", "rate_b")}, {r("a.rate - b.rate", "delta")} FROM a JOIN b USING (class)""",
)
def compare_rates(spark, sf):
    p = predictions(spark, sf)
    return rounded(
        metrics.compare_rates(
            metrics.detection_rates(p, F.col("pred") == F.col("label")),
            metrics.detection_rates(p, F.col("raw_score") < 0.1135),
        )
    )


OVR = f"{P}, ovr AS (SELECT {NAMES}[i] AS class, {ARR}[i] AS p, label = {NAMES}[i] AS y FROM predictions, range(1, 9) t(i))"


def _grid_sql(grid):
    return "grid(t) AS (VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in grid) + ")"


def _best_sql(grid):
    return f"""WITH {OVR}, {_grid_sql(grid)}, s AS (SELECT class, t, count(*) FILTER (y AND p >= t) AS tp, count(*) FILTER (NOT y AND p >= t) AS fp, count(*) FILTER (y) AS pos FROM ovr, grid GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp + fp + pos > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1 FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, t) AS rn FROM f)
SELECT class, {r("f1")}, {r("CASE WHEN f1 > 0 THEN t ELSE 0.5 END", "threshold")} FROM b WHERE rn = 1"""


@register("ml_best_thresholds", _best_sql(metrics.COARSE))
def best_thresholds(spark, sf):
    return rounded(metrics.best_thresholds(predictions(spark, sf), probs()))


@register("ml_best_thresholds_fine", _best_sql(metrics.FINE))
def best_thresholds_fine(spark, sf):
    return rounded(metrics.best_thresholds(predictions(spark, sf), probs(), grid=metrics.FINE))


OFFSETS = [(0.005, -0.3), (0.008, -0.2), (0.01, -0.1), (0.015, 0.0), (0.02, 0.1)]


@register(
    "ml_contamination_sweep",
    f"""WITH {P}, off(contamination, o) AS (VALUES {", ".join(f"({c}::DOUBLE, {o}::DOUBLE)" for c, o in OFFSETS)}), {_grid_sql(metrics.ANOMALY_GRID)},
c AS (SELECT contamination, 1 / (1 + exp(raw_score - o)) AS p, label <> 'BENIGN' AS y FROM predictions, off),
s AS (SELECT contamination, t, count(*) FILTER (y AND p >= t) AS tp, count(*) FILTER (NOT y AND p >= t) AS fp, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM c, grid GROUP BY ALL),
b AS (SELECT *, 2 * tp / (tp + fp + pos) AS f1, row_number() OVER (PARTITION BY contamination ORDER BY 2 * tp / (tp + fp + pos) DESC, t) AS rn FROM s),
o AS (SELECT contamination, t AS threshold, f1, tp / pos AS tpr, fp / neg AS fpr, fp / neg <= 0.05 AS feasible FROM b WHERE rn = 1)
SELECT {r("contamination")}, {r("threshold")}, {r("f1")}, {r("tpr")}, {r("fpr")}, feasible,
 row_number() OVER (ORDER BY feasible DESC, CASE WHEN feasible THEN -tpr ELSE fpr END, contamination) = 1 AS chosen FROM o""",
)
def contamination_sweep(spark, sf):
    scored = predictions(spark, sf).select(F.col("raw_score").alias("raw"), (F.col("label") != "BENIGN").alias("is_attack"))
    offsets = spark.createDataFrame(OFFSETS, "contamination double, offset double")
    return rounded(metrics.contamination_sweep(scored, offsets))


# --- ROC -------------------------------------------------------------------

ROC = f"""{OVR}, h AS (SELECT class, p, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM ovr GROUP BY ALL),
roc AS (SELECT class, p AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an
 FROM h WINDOW w AS (PARTITION BY class ORDER BY p DESC)),
pts AS (SELECT *, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS tpr, CASE WHEN an > 0 THEN fp / an ELSE 0 END AS fpr FROM roc),
corners AS (SELECT * FROM (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM pts WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)) WHERE np IS NULL OR np <> pos OR nn <> neg OR rn = 1)"""


def roc(spark, sf):
    return metrics.roc_points(metrics._one_vs_rest(predictions(spark, sf), probs(), "label", CL))


@register("ml_roc_points", f"WITH {ROC} SELECT class, {r('threshold')}, {r('tpr')}, {r('fpr')} FROM pts")
def roc_points(spark, sf):
    return rounded(roc(spark, sf).select("class", "threshold", "tpr", "fpr"))


@register("ml_roc_corners", f"WITH {ROC} SELECT class, {r('threshold')}, {r('tpr')}, {r('fpr')} FROM corners")
def roc_corners(spark, sf):
    return rounded(metrics.drop_collinear(roc(spark, sf)).select("class", "threshold", "tpr", "fpr"))


@register(
    "ml_roc_auc",
    f"WITH {ROC}, a AS (SELECT class, CASE WHEN max(ap) * max(an) > 0 THEN sum(neg * (tp - pos / 2)) / (max(ap)::DOUBLE * max(an)) ELSE 0 END AS auc FROM pts GROUP BY 1) SELECT class, {r('auc')} FROM a",
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(roc(spark, sf)))


@register(
    "ml_roc_macro_auc",
    f"""WITH {ROC}, cv AS (SELECT class, fpr, tpr FROM corners UNION ALL SELECT DISTINCT class, 0.0::DOUBLE, 0.0::DOUBLE FROM corners),
st AS (SELECT class, fpr, min(tpr) AS lo, max(tpr) AS hi FROM cv GROUP BY ALL), ax AS (SELECT DISTINCT fpr AS f FROM st),
g AS (SELECT s.class, f FROM ax, (SELECT DISTINCT class FROM st) s), l AS (SELECT g.class, f, st.fpr AS x0, st.hi AS y0 FROM g ASOF JOIN st ON g.class = st.class AND g.f >= st.fpr),
b AS (SELECT l.*, st.fpr AS x1, st.lo AS y1 FROM l ASOF LEFT JOIN st ON l.class = st.class AND l.f < st.fpr),
m AS (SELECT f, sum(CASE WHEN x1 IS NULL OR f = x0 THEN y0 ELSE y0 + (y1 - y0) * (f - x0) / (x1 - x0) END) / 8 AS t FROM b GROUP BY f),
z AS (SELECT f, t, lag(f) OVER w AS pf, lag(t) OVER w AS pt FROM m WINDOW w AS (ORDER BY f)), res AS (SELECT sum((f - pf) * (t + pt) / 2) AS macro_auc FROM z)
SELECT {r("macro_auc")} FROM res""",
)
def macro_auc(spark, sf):
    return rounded(metrics.macro_auc(metrics.drop_collinear(roc(spark, sf)), 8))


BIN = f"""{P}, bh AS (SELECT 1 / (1 + exp(raw_score)) AS p, count(*) FILTER (label <> 'BENIGN') AS pos, count(*) FILTER (label = 'BENIGN') AS neg FROM predictions GROUP BY 1),
br AS (SELECT p AS threshold, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM bh)"""


def binary_roc(spark, sf):
    p = predictions(spark, sf).select(
        metrics.anomaly_gate(F.col("raw_score"))[1].alias("p"), (F.col("label") != "BENIGN").alias("y")
    )
    return metrics.roc_points(p, [])


@register("ml_binary_auc", f"WITH {BIN}, a AS (SELECT sum(neg * (tp - pos / 2)) / (max(ap)::DOUBLE * max(an)) AS auc FROM br) SELECT {r('auc')} FROM a")
def binary_auc(spark, sf):
    return rounded(metrics.roc_auc(binary_roc(spark, sf), []))


@register(
    "ml_operating_point",
    f"WITH {BIN} SELECT {r('threshold')}, {r('tp / ap', 'tpr')}, {r('fp / an', 'fpr')} FROM br ORDER BY abs(threshold - 0.475), br.threshold DESC LIMIT 1",
)
def operating_point(spark, sf):
    return rounded(metrics.operating_point(binary_roc(spark, sf), 0.475))


# --- targets, registry, latency, evaluation --------------------------------


@register(
    "ml_targets",
    f"WITH {ALL} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(m, 'value')}, {t}::DOUBLE AS target, {m} {op} {t} AS met FROM total" for m, op, t in metrics.TARGETS
    ),
)
def targets(spark, sf):
    return rounded(metrics.assess(metrics.overall(per_class(spark, sf))), 4, "value")


MODELS = [("rf", "pred = label"), ("iforest", "(raw_score < 0.1135e0) = (label <> 'BENIGN')"), ("ensemble", "pred = label OR event_id % 9 = 0")]
MODELS_SQL = f"{P}, res AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, 'accuracy' AS metric, avg(({c})::INT) AS value FROM predictions UNION ALL "
    f"SELECT '{m}', 'benign_accuracy', avg(({c})::INT) FROM predictions WHERE label = 'BENIGN'" for m, c in MODELS
) + ")"


def model_results(spark, sf):
    p = predictions(spark, sf)
    parts = []
    for m, cond in MODELS:
        ok = F.expr(f"CAST({cond} AS DOUBLE)")
        one = p.agg(F.avg(ok).alias("accuracy"), F.avg(F.when(F.col("label") == "BENIGN", ok)).alias("benign_accuracy"))
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])
        parts.append(one.select(F.lit(m).alias("model"), F.explode(pairs).alias("x")).select("model", "x.*"))
    return prep.concat_files(parts)


@register(
    "ml_compare_models",
    f"""WITH {MODELS_SQL}, b AS (SELECT metric, max(value) AS best_single, max_by(model, value) AS best_model FROM res WHERE model <> 'ensemble' GROUP BY 1)
SELECT metric, {r("value", "ensemble")}, {r("best_single")}, best_model, {r("value - best_single", "gain")} FROM res JOIN b USING (metric) WHERE model = 'ensemble'""",
)
def compare_models(spark, sf):
    return rounded(metrics.compare_models(model_results(spark, sf), "ensemble"))


_MODEL_ROWS = [
    "o_orderkey AS model_id", "concat('type', CAST(o_custkey % 40 AS STRING)) AS model_type", "o_orderkey % 300 = 7 AS is_active",
]


def models(spark, sf):
    return ad.table(spark, sf, "orders").selectExpr(*_MODEL_ROWS, "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS trained_us")


@register("ml_registry", f"SELECT {', '.join(_MODEL_ROWS)}, epoch_us(o_orderdate) AS trained_us FROM orders")
def registry(spark, sf):
    return metrics.model_registry(models(spark, sf))


@register("ml_registry_conflicts", f"SELECT model_type, count(*) AS active FROM (SELECT {', '.join(_MODEL_ROWS)} FROM orders) WHERE is_active GROUP BY 1 HAVING count(*) > 1")
def registry_conflicts(spark, sf):
    return metrics.conflicting_active(models(spark, sf))


def _lat_sql(source):
    return f"""SELECT {r("quantile_cont(value, 0.5)", "p50")}, {r("quantile_cont(value, 0.95)", "p95")}, {r("quantile_cont(value, 0.99)", "p99")},
 {r("avg(value)", "mean")}, {r("max(value)", "max")}, count(value) AS n FROM {source}"""


def latencies(spark, sf):
    return ad.table(spark, sf, "events").select("event_id", "value")


@register("ml_latency", _lat_sql("events"))
def latency(spark, sf):
    return rounded(metrics.latency_stats(latencies(spark, sf), "value"))


@register("ml_latency_recent", _lat_sql("(SELECT * FROM events ORDER BY event_id DESC LIMIT 1000)"))
def latency_recent(spark, sf):
    return rounded(metrics.latency_stats(metrics.recent(latencies(spark, sf), "event_id"), "value"))


@register("ml_latency_cdf", f"SELECT DISTINCT {r('value')}, {r('cume_dist() OVER (ORDER BY value)', 'share')} FROM events")
def latency_cdf(spark, sf):
    return rounded(metrics.latency_cdf(latencies(spark, sf), "value"))


EVAL = f"""{P}, {ad.cte("alerts")}, ev AS (SELECT p.flow_id, p.label, coalesce(a.attack_type, 'BENIGN') AS pred FROM predictions p
 LEFT JOIN (SELECT * FROM alerts WHERE confidence >= 0.4e0) a USING (flow_id))"""


def evaluated(spark, sf):
    a = ad.load(spark, sf, "alerts").filter("confidence >= 0.4")
    return metrics.evaluate_alerts(predictions(spark, sf), a)


@register(
    "ml_alert_scores",
    f"""WITH {EVAL}, t AS (SELECT label AS class, count(*) FILTER (pred <> 'BENIGN') AS tp, count(*) FILTER (pred = 'BENIGN') AS fn FROM ev WHERE label <> 'BENIGN' GROUP BY 1)
SELECT class, tp, fn, {r("round(tp / (tp + fn), 3)", "tpr")}, {r("CASE WHEN tp > 0 THEN 1 ELSE 0 END", "precision")}, {r("round(2 * tp / (2 * tp + fn), 3)", "f1")} FROM t""",
)
def alert_scores(spark, sf):
    return rounded(metrics.alert_scores(evaluated(spark, sf)))


@register(
    "ml_alert_summary",
    f"""WITH {EVAL}, t AS (SELECT label, round(2 * count(*) FILTER (pred <> 'BENIGN') / (count(*) + count(*) FILTER (pred <> 'BENIGN')), 3) AS f1 FROM ev WHERE label <> 'BENIGN' GROUP BY 1),
c AS (SELECT c AS class, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS picked, count(*) FILTER (label = c AND pred = c) AS tp FROM ev, (SELECT unnest({NAMES}) AS c) GROUP BY c),
m AS (SELECT (SELECT avg(f1) FROM t) AS mean_f1, (SELECT avg((pred <> 'BENIGN')::INT) FROM ev WHERE label = 'BENIGN') AS fpr,
 (SELECT sum(CASE WHEN support + picked > 0 THEN 2 * tp / (support + picked) ELSE 0 END * support) / sum(support) FROM c) AS weighted_f1)
SELECT {r("mean_f1")}, {r("fpr")}, {r("weighted_f1")}, mean_f1 >= 0.95 AS f1_pass, fpr <= 0.05 AS fpr_pass FROM m""",
)
def alert_summary(spark, sf):
    return rounded(metrics.alert_summary(evaluated(spark, sf)))
