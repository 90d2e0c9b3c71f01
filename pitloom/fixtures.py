"""Fixture populations (``fx_*``) put on the driver's test tables.

Each fixture is one SQL text with ``{name}`` placeholders. Spark binds the
placeholders to DataFrames through ``spark.sql(text, **frames)`` (no global temp
views); the DuckDB oracle gets the same text with bare table names as CTEs.
``{TS}`` is the zone-less timestamp type of the dialect.

Fault injection (missing predictions, stray rows, duplicate deliveries, missing
metrics) uses fixed residues of an id; every fixture still reads its whole table.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from pitloom.session import configure

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {
    "fx_features": """
SELECT CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS feature_ts,
       MAX(o_totalprice) AS signal_a, CAST(COUNT(*) AS DOUBLE) AS signal_b
FROM {orders} GROUP BY o_custkey, o_orderdate""",
    "fx_features_raw": """
SELECT CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS feature_ts, o_totalprice AS signal_a
FROM {orders}""",
    "fx_actuals": """
SELECT CAST(o_custkey AS STRING) AS entity_id, MIN(l_shipdate) AS event_ts,
       MIN(l_shipdate) + INTERVAL 30 DAY AS label_available_ts, MAX(l_quantity) AS actual_quantity,
       CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS correlation_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_orderkey, l_linenumber""",
    # Actuals of the order itself: line count per order, known 30 days after the order.
    # Every label has the feature row of its own order at the same time (exact match).
    "fx_order_actuals": """
SELECT CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS event_ts,
       o_orderdate + INTERVAL 30 DAY AS label_available_ts, CAST(COUNT(*) AS DOUBLE) AS actual_quantity,
       CAST(o_orderkey AS STRING) AS correlation_id
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
GROUP BY o_custkey, o_orderdate, o_orderkey""",
    "fx_actuals_raw": """
SELECT CAST(o_custkey AS STRING) AS entity_id, l_shipdate AS event_ts, l_quantity AS actual_quantity,
       CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS correlation_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_scoring": """
SELECT CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS feature_ts,
       MAX(o_totalprice) AS signal_a, CAST(COUNT(*) AS DOUBLE) AS signal_b,
       CAST(MIN(o_orderkey) AS STRING) AS correlation_id,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) AS source_batch_id
FROM {orders} GROUP BY o_custkey, o_orderdate""",
    "fx_predictions": """
SELECT entity_id, feature_ts AS prediction_ts, source_batch_id, correlation_id,
       CAST(CAST(correlation_id AS BIGINT) % 5 AS STRING) AS prediction_class
FROM {fx_scoring}""",
    "fx_predictions_broken": """
SELECT * FROM {fx_predictions} WHERE CAST(correlation_id AS BIGINT) % 97 <> 0
UNION ALL
SELECT entity_id, prediction_ts, 'stray' AS source_batch_id, correlation_id, prediction_class
FROM {fx_predictions} WHERE CAST(correlation_id AS BIGINT) % 101 = 0""",
    # Published table: batches up to 1998. Staging: batches from 1998 on, so batch
    # 1998 is republished (update path) and later batches are new (insert path).
    "fx_target": """
SELECT CONCAT('pred_', correlation_id) AS prediction_id, source_batch_id, prediction_class,
       CAST(7 AS DOUBLE) AS actual_quantity,
       CAST('2026-01-01 00:00:00' AS {TS}) AS created_at, CAST('2026-01-01 00:00:00' AS {TS}) AS updated_at
FROM {fx_predictions} WHERE source_batch_id <= '1998'""",
    "fx_stage": """
SELECT CONCAT('pred_', correlation_id) AS prediction_id, source_batch_id,
       CAST((CAST(correlation_id AS BIGINT) + 1) % 5 AS STRING) AS prediction_class,
       CAST(NULL AS DOUBLE) AS actual_quantity,
       CAST('2026-02-01 00:00:00' AS {TS}) AS created_at, CAST('2026-02-01 00:00:00' AS {TS}) AS updated_at
FROM {fx_predictions} WHERE source_batch_id >= '1998'""",
    "fx_run_events": """
SELECT CAST(event_id AS STRING) AS event_id, ts AS event_ts,
       CASE WHEN event_type = 'error' THEN 'Microsoft.MachineLearningServices.RunStatusChanged' ELSE event_type END AS event_type,
       CAST(user_id AS STRING) AS run_id, 'Failed' AS run_status,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 50
            THEN 'has failed due to one or more features violating metric thresholds' ELSE '' END AS breach_tag
FROM {events}""",
    "fx_run_events_dup": """
SELECT * FROM {fx_run_events}
UNION ALL
SELECT * FROM {fx_run_events} WHERE CAST(event_id AS BIGINT) % 4 = 0""",
    # Raw event payloads as delivered (JSON text), with malformed ones injected:
    # not JSON, no id, data not an object, status event without a run id, a numeric id;
    # key case varies.
    "fx_raw_events": """
SELECT event_id, event_ts,
  CASE
    WHEN CAST(event_id AS BIGINT) % 97 = 0 THEN 'not json'
    WHEN CAST(event_id AS BIGINT) % 89 = 0 THEN '{"eventType":"' || event_type || '","data":{}}'
    WHEN CAST(event_id AS BIGINT) % 83 = 0 THEN '{"id":"' || event_id || '","eventType":"' || event_type || '","data":"' || run_id || '"}'
    WHEN CAST(event_id AS BIGINT) % 79 = 0 THEN '{"id":"' || event_id || '","eventType":"' || event_type || '","data":{"runStatus":"' || run_status || '"}}'
    WHEN CAST(event_id AS BIGINT) % 73 = 0 THEN '{"id":' || event_id || ',"eventType":"' || event_type || '","data":{}}'
    ELSE '{"id":"' || event_id || '","' || CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN 'eventType' ELSE 'EventType' END
         || '":"' || event_type
         || CASE WHEN CAST(event_id AS BIGINT) % 71 = 0 THEN '' WHEN CAST(event_id AS BIGINT) % 67 = 0 THEN '","eventTime":"yesterday'
                 WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN '","eventTime":"' || CAST(event_ts + INTERVAL 2 HOUR AS STRING) || '+02:00'
                 ELSE '","eventTime":"' || CAST(event_ts AS STRING) || 'Z' END
         || '","subject":"runs/' || run_id || '","data":{"'
         || CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN 'RunId' ELSE 'runId' END || '":"' || run_id
         || '","runStatus":"' || run_status || '","runTags":{"azureml_modelmonitor_threshold_breached":"' || breach_tag || '"}}}'
  END AS body
FROM {fx_run_events}""",
    # Deliveries of the event bus (at least once), as raw text: every event once within minutes, a quarter once more up to
    # 39 hours later (past the 24-hour lifetime when late), some in a thirteenth attempt.
    "fx_deliveries": """
SELECT event_id, body, event_ts + INTERVAL 1 MINUTE * CAST(CAST(event_id AS BIGINT) % 7 AS INT) AS delivered_ts, 1 AS attempt FROM {fx_raw_events}
UNION ALL
SELECT event_id, body, event_ts + INTERVAL 1 HOUR * CAST(CAST(event_id AS BIGINT) % 40 AS INT) AS delivered_ts, 2 AS attempt
FROM {fx_raw_events} WHERE CAST(event_id AS BIGINT) % 4 = 0
UNION ALL
SELECT event_id, body, event_ts + INTERVAL 23 HOUR AS delivered_ts, 13 AS attempt
FROM {fx_raw_events} WHERE CAST(event_id AS BIGINT) % 53 = 0""",
    "fx_job_status": """
SELECT DISTINCT CAST(user_id AS STRING) AS run_id,
       CASE user_id % 3 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Completed' ELSE 'FAILED' END AS status
FROM {events}""",
    "fx_drift": """
SELECT CASE WHEN o_orderdate < CAST('1999-01-01 00:00:00' AS {TS}) THEN 'reference' ELSE 'current' END AS side,
       o_totalprice AS signal_a, CAST(o_custkey % 97 AS DOUBLE) AS signal_b, o_orderpriority AS prediction_class,
       CAST(o_orderkey AS BIGINT) AS row_id
FROM {orders}""",
    # Scored rows of a model in use: a third of the labels is not known yet, some predictions miss.
    "fx_monitor": """
SELECT o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INT) AS scored_ts, o_totalprice AS signal_a,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS DOUBLE) END AS signal_b,
       o_orderpriority AS prediction_class,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'other' ELSE o_orderpriority END AS actual_class
FROM {orders}""",
    "fx_scored": """
SELECT CAST(doc_id AS STRING) AS correlation_id, CAST(n_chars % 2 AS STRING) AS prediction_class,
       CAST(n_chars % 10 + 1 AS DOUBLE) / 12 AS p_class_1
FROM {documents}""",
    "fx_truth": """
SELECT CAST(doc_id AS STRING) AS correlation_id, CAST(quality AS STRING) AS actual_class FROM {labels}""",
    # One candidate a customer, in fifty segments; some lack a metric.
    "fx_candidate_metrics": """
SELECT CONCAT('candidate-', CAST(o_custkey AS STRING)) AS model_version, CAST(o_custkey % 50 AS INT) AS segment, 'macro_f1' AS metric,
       CAST(0.55 + 0.01 * (COUNT(*) % 40) AS DOUBLE) AS value FROM {orders} GROUP BY o_custkey
UNION ALL
SELECT CONCAT('candidate-', CAST(o_custkey AS STRING)), CAST(o_custkey % 50 AS INT), 'log_loss',
       CAST(1.00 - 0.01 * (COUNT(*) % 35) AS DOUBLE) FROM {orders} WHERE o_custkey % 7 <> 0 GROUP BY o_custkey""",
    # What serves each segment: the last ten have no champion, one champion has an old mapping, four were never measured.
    "fx_champions": """
SELECT DISTINCT CAST(o_custkey % 50 AS INT) AS segment, CONCAT('champion-', CAST(o_custkey % 50 AS STRING)) AS champion_version,
       CASE WHEN o_custkey % 50 = 17 THEN 'quantity-v0' ELSE 'quantity-v1' END AS champion_mapping
FROM {orders} WHERE o_custkey % 50 < 40""",
    "fx_champion_metrics": """
SELECT segment, 'macro_f1' AS metric, CAST(0.60 + 0.004 * segment AS DOUBLE) AS value FROM {fx_champions} WHERE segment % 9 <> 4
UNION ALL
SELECT segment, 'log_loss', CAST(0.92 - 0.002 * segment AS DOUBLE) FROM {fx_champions} WHERE segment % 9 <> 4 AND segment % 11 <> 5""",
    "fx_rules": """
SELECT 1 AS rule_no, 'macro_f1' AS metric, 'maximize' AS direction, CAST(0.70 AS DOUBLE) AS threshold, CAST(0.01 AS DOUBLE) AS minimum_delta
UNION ALL
SELECT 2, 'log_loss', 'minimize', CAST(0.90 AS DOUBLE), CAST(0.00 AS DOUBLE)""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def dependencies(name: str) -> list[str]:
    return [p for p in dict.fromkeys(_PLACEHOLDER.findall(FIXTURES[name])) if p != "TS"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build ``fx_<name>`` (or a base table) as a DataFrame on the tables of ``sf_dir``."""
    configure(spark)
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    frames = {dep: fixture(spark, sf_dir, dep) for dep in dependencies(name)}
    # spark.sql formats the text: keep the placeholders, double every other brace.
    text = FIXTURES[name].replace("{TS}", "TIMESTAMP_NTZ").replace("{", "{{").replace("}", "}}")
    for dep in frames:
        text = text.replace("{{" + dep + "}}", "{" + dep + "}")
    return spark.sql(text, **frames)


@lru_cache(maxsize=None)
def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in ordered:
            return
        for dep in dependencies(n):
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return ordered


def duck_with(sql: str) -> str:
    """Prefix an oracle query with the CTEs of every ``fx_*`` view it mentions."""
    used = tuple(sorted(set(re.findall(r"\bfx_\w+", sql)) & set(FIXTURES)))
    if not used:
        return sql
    ctes = []
    for n in _closure(used):
        body = _PLACEHOLDER.sub(lambda m: "TIMESTAMP" if m.group(1) == "TS" else m.group(1), FIXTURES[n])
        ctes.append(f"{n} AS ({body.strip()})")
    body = sql.strip()
    if re.match(r"(?i)^with\s", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
