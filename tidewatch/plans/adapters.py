"""The given tables seen as packets, alerts, engine scores and the like.

Each adapter is a list of projections over one table, written so that Spark and
DuckDB read the same text; only the clock function differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EPOCH = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

_CLIENT = "concat('10.0.0.', CAST(user_id % 16 AS STRING))"
_SERVER = f"concat('10.0.1.', CAST({K} % 4 AS STRING))"
_CPORT = f"CAST(1024 + {K} % 8 AS INT)"
_SPORT = (
    "CAST(CASE user_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 22 WHEN 2 THEN 443 ELSE 3306 END AS INT)"
)
_PROTO = (
    "CASE WHEN event_id % 10 = 0 THEN 'UDP' WHEN event_id % 10 = 1 THEN 'ICMP' ELSE 'TCP' END"
)
_BACK = "event_id % 3 = 0"
_ICMP = "event_id % 10 = 1"
_TYPE = (
    "CASE event_type WHEN 'error' THEN 'DoS' WHEN 'click' THEN 'PortScan' "
    "WHEN 'signup' THEN 'BruteForce' WHEN 'purchase' THEN 'WebAttack' ELSE 'Botnet' END"
)

PACKETS = [
    "event_id AS packet_id",
    "{epoch} AS t_us",
    f"CASE WHEN {_BACK} THEN {_SERVER} ELSE {_CLIENT} END AS src_ip",
    f"CASE WHEN {_BACK} THEN {_CLIENT} ELSE {_SERVER} END AS dst_ip",
    f"CASE WHEN {_ICMP} THEN NULL WHEN {_BACK} THEN {_SPORT} ELSE {_CPORT} END AS src_port",
    f"CASE WHEN {_ICMP} THEN NULL WHEN {_BACK} THEN {_CPORT} ELSE {_SPORT} END AS dst_port",
    f"{_PROTO} AS protocol",
    "CAST(60 + event_id * 37 % 1400 AS INT) AS length",
    "CAST(CASE WHEN event_id % 50 = 0 THEN 4 WHEN event_type = 'error' THEN 2 "
    "WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'click' THEN 24 ELSE 16 END AS INT) "
    "AS flag_bits",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat(event_type, ' ', props) END AS payload",
    "CAST(event_id % 3 * 8 AS INT) AS icmp_type",
]


def _score(p: int) -> str:
    return (
        f"CASE WHEN event_id % 11 = 0 THEN 97e-2 ELSE "
        f"CAST(event_id * {p} % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END"
    )


# one row per scored flow, all engines side by side
SCORES = [
    "concat('f', CAST(event_id AS STRING)) AS flow_id",
    "event_id",
    "{epoch} AS t_us",
    f"{_CLIENT} AS src_ip",
    f"{_SERVER} AS dst_ip",
    f"CASE WHEN {_ICMP} THEN NULL ELSE {_CPORT} END AS src_port",
    f"CASE WHEN {_ICMP} THEN NULL ELSE {_SPORT} END AS dst_port",
    f"{_PROTO} AS protocol",
    f"{_TYPE} AS attack_type",
    "CASE WHEN event_id % 11 = 0 THEN 97e-2 WHEN event_id % 4 = 0 THEN 1e0 ELSE 0e0 END AS sig_conf",
    f"{_score(7919)} AS rf_conf",
    f"{_score(104729)} AS lstm_conf",
    f"{_score(1299709)} AS if_conf",
]

# one row per alert, with workflow columns
ALERTS = [
    "concat('a', CAST(event_id AS STRING)) AS alert_id",
    "event_id",
    "concat('f', CAST(event_id AS STRING)) AS flow_id",
    "CASE event_id % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'false_positive' "
    "WHEN 2 THEN 'escalated' ELSE 'open' END AS status",
    "CASE WHEN event_id % 17 = 0 THEN 'CRITICAL' WHEN event_id % 7 = 0 THEN 'HIGH' "
    "WHEN event_id % 3 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
    f"{_TYPE} AS attack_type",
    f"{_score(7919)} AS confidence",
    f"{_CLIENT} AS src_ip",
    f"{_SERVER} AS dst_ip",
    f"CASE WHEN {_ICMP} THEN NULL ELSE {_CPORT} END AS src_port",
    f"CASE WHEN {_ICMP} THEN NULL ELSE {_SPORT} END AS dst_port",
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'UDP' "
    "WHEN event_id % 10 = 1 THEN 'ICMP' ELSE 'TCP' END AS protocol",
    "CASE event_id % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'ml' ELSE 'both' END AS detected_by",
    "{epoch} AS t_us",
    "CASE WHEN event_id % 5 = 0 THEN {epoch} + (event_id % 90) * 60000000 END AS ack_us",
    "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 4 = 0 THEN "
    "concat('seen ', event_type, chr(10), '[Note] 2024-01-0', CAST(1 + event_id % 9 AS STRING), "
    "'T10:00:00Z checked ', props, chr(10), '[Note] plain words', chr(10), '[Note]  ') "
    "ELSE concat('seen ', event_type) END AS description",
    "concat('r', CAST(user_id % 12 AS STRING)) AS rule_id",
    "event_id % 9 = 0 AS attack_chain",
]

# analyst actions against a small pool of alerts
ACTIONS = [
    "event_id AS action_id",
    "{epoch} AS t_us",
    "concat('a', CAST(user_id * 7 % 400 AS STRING)) AS alert_id",
    "CASE event_id % 8 WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'escalate' WHEN 2 THEN 'resolve' "
    "WHEN 3 THEN 'false_positive' WHEN 4 THEN 'reopen' WHEN 5 THEN 'resolve' "
    "WHEN 6 THEN 'acknowledge' ELSE 'resolve' END AS action",
    "concat('analyst', CAST(event_id % 5 AS STRING)) AS performed_by",
    "CASE WHEN event_id % 12 = 5 THEN '  ' WHEN event_id % 3 = 0 THEN NULL "
    "ELSE concat(' note ', event_type) END AS note",
    "CASE WHEN event_id % 9 = 0 THEN 'wrong' WHEN event_id % 2 = 0 THEN 'benign' "
    "ELSE 'true_positive' END AS resolution_type",
]

# ground truth beside a prediction and class probabilities
CLASSES = ["BENIGN", "Botnet", "BruteForce", "DDoS", "DoS", "Infiltration", "PortScan", "WebAttack"]
_CLASS_SQL = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))
_TRUE = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE (user_id * 5 + 3) % 8 END"
PREDICTIONS = [
    "event_id",
    "concat('f', CAST(event_id AS STRING)) AS flow_id",
    f"CASE {_TRUE} {_CLASS_SQL} END AS label",
    f"CASE CASE WHEN event_id % 7 = 0 THEN ({_TRUE} + 1) % 8 WHEN event_id % 31 = 0 THEN 0 "
    f"ELSE {_TRUE} END {_CLASS_SQL} END AS pred",
    *[
        f"CAST((event_id * {p} + {i} * 61 + CASE WHEN {_TRUE} = {i} THEN 400 ELSE 0 END) % 1000 "
        f"AS DOUBLE) / CAST(1000 AS DOUBLE) AS p{i}"
        for i, p in enumerate([7919, 104729, 1299709, 15485863, 611953, 48611, 17389, 224737])
    ],
    "CAST(event_id * 7919 % 2000 - 1000 AS DOUBLE) / CAST(2000 AS DOUBLE) AS raw_score",
]

# labelled flow rows as they come from capture CSV files
LABELLED = [
    "event_id AS pos",
    "concat('day', CAST(user_id % 5 AS STRING)) AS file",
    "CASE user_id % 14 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS Hulk' WHEN 2 THEN 'DDoS' "
    "WHEN 3 THEN 'PortScan' WHEN 4 THEN 'FTP-Patator' WHEN 5 THEN 'SSH-Patator' WHEN 6 THEN 'Bot' "
    "WHEN 7 THEN 'Infiltration' WHEN 8 THEN ' Web Attack - XSS' WHEN 9 THEN 'Web Attack - Sql Injection' "
    "WHEN 10 THEN 'Heartbleed' WHEN 11 THEN 'web brute force' WHEN 12 THEN 'something else' "
    "ELSE 'DoS slowloris ' END AS raw_label",
    "CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 89 = 0 THEN "
    "CAST('-Infinity' AS DOUBLE) WHEN event_id % 83 = 0 THEN NULL ELSE value END AS x0",
    f"CASE WHEN user_id % 5 = 3 THEN NULL ELSE CAST({K} AS DOUBLE) END AS x1",
    "CAST(5 AS DOUBLE) AS x2",
]

# change log of the rule registry
RULE_CHANGES = [
    "event_id AS change_id",
    "concat('S', CAST(user_id AS STRING)) AS rule_id",
    "CASE WHEN event_type = 'signup' THEN 'create' WHEN event_id % 40 = 7 THEN 'delete' "
    "WHEN event_type = 'click' THEN 'toggle' ELSE 'update' END AS op",
    "CASE WHEN event_type IN ('signup', 'view') THEN concat('rule ', props) END AS rule_name",
    "CASE WHEN event_type IN ('signup', 'error') THEN CASE event_id % 3 WHEN 0 THEN 'dos' "
    "WHEN 1 THEN 'portscan' ELSE 'webattack' END END AS attack_category",
    "CASE WHEN event_type IN ('signup', 'purchase') THEN CASE event_id % 4 WHEN 0 THEN 'low' "
    "WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END END AS severity",
    "CASE WHEN event_type = 'signup' THEN TRUE WHEN event_type = 'click' THEN event_id % 2 = 0 "
    "END AS enabled",
]

AUDIT = [
    "event_id AS id",
    "concat('u', CAST(user_id AS STRING)) AS user_id",
    "CASE WHEN event_type = 'view' THEN 'LOGIN_FAILED_WRONG_PASSWORD' "
    "WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'LOGIN_SUCCESS' "
    "WHEN event_type = 'error' THEN 'ALERT_RESOLVE' ELSE 'ALERT_ACKNOWLEDGE' END AS action",
    "concat('a', CAST(event_id % 400 AS STRING)) AS entity_id",
    "{epoch} AS t_us",
]

ALL = {
    "packets": PACKETS,
    "scores": SCORES,
    "alerts": ALERTS,
    "actions": ACTIONS,
    "predictions": PREDICTIONS,
    "labelled": LABELLED,
    "rule_changes": RULE_CHANGES,
    "audit": AUDIT,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    exprs = [e.replace("{epoch}", EPOCH["spark"]) for e in ALL[entity]]
    return table(spark, sf_dir, "events").selectExpr(*exprs)


def cte(entity: str) -> str:
    """The same entity as a DuckDB common table expression."""
    exprs = ",\n  ".join(e.replace("{epoch}", EPOCH["duckdb"]) for e in ALL[entity])
    return f"{entity} AS (SELECT {exprs} FROM events)"
