"""Registered queries: reconciliation, publication and monitor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.functions.quantity import label_actuals
from pitloom.operators.reconcile import (
    delayed_label_join,
    missing_and_extra,
    normalise_keys,
    one_to_one_join,
    reconcile,
    reconcile_counts,
)
from pitloom.plans.join_queries import training_spine, zoned_texts
from pitloom.plans.quality_queries import provenance
from pitloom.plans.registry import CONTRACT, fx, register
from pitloom.session import scratch_path
from pitloom.sources.monitor import monitor_tables
from pitloom.sources.publish import publish, read_predictions, stage_rows, upsert

# ---------------------------------------------------------------- J4 / U2 / A16
_MATCHED_SQL = """
(SELECT COALESCE(e.entity_id, d.entity_id) AS entity_id, COALESCE(e.prediction_ts, d.prediction_ts) AS prediction_ts,
        COALESCE(e.source_batch_id, d.source_batch_id) AS source_batch_id,
        COALESCE(e.correlation_id, d.correlation_id) AS correlation_id,
        CASE WHEN e.n IS NOT NULL AND d.n IS NOT NULL THEN 'both' WHEN e.n IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side,
        COALESCE(d.n, 0) AS delivered_rows
 FROM (SELECT entity_id, feature_ts AS prediction_ts, source_batch_id, correlation_id, COUNT(*) AS n FROM fx_scoring GROUP BY ALL) e
 FULL OUTER JOIN (SELECT entity_id, prediction_ts, source_batch_id, correlation_id, COUNT(*) AS n FROM fx_predictions_broken GROUP BY ALL) d
   ON e.entity_id IS NOT DISTINCT FROM d.entity_id AND e.prediction_ts IS NOT DISTINCT FROM d.prediction_ts
  AND e.source_batch_id IS NOT DISTINCT FROM d.source_batch_id AND e.correlation_id IS NOT DISTINCT FROM d.correlation_id) m"""


def _matched(spark, sf_dir):
    expected = normalise_keys(fx(spark, sf_dir, "fx_scoring"), ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    delivered = normalise_keys(
        fx(spark, sf_dir, "fx_predictions_broken"), ["entity_id", "prediction_ts", "source_batch_id", "correlation_id"]
    )
    return reconcile(expected, delivered)


@register(
    "j4_reconcile_counts",
    f"SELECT side, CAST(COUNT(*) AS BIGINT) AS keys, CAST(SUM(GREATEST(delivered_rows - 1, 0)) AS BIGINT) AS duplicate_rows FROM {_MATCHED_SQL} GROUP BY side",
)
def j4_reconcile_counts(spark, sf_dir):
    return reconcile_counts(_matched(spark, sf_dir))


@register(
    "j4_missing_and_extra",
    f"SELECT entity_id, prediction_ts, source_batch_id, correlation_id, side FROM {_MATCHED_SQL} WHERE side <> 'both'",
)
def j4_missing_and_extra(spark, sf_dir):
    return missing_and_extra(_matched(spark, sf_dir))


@register(
    "j4_zoned_texts",
    f"SELECT side, CAST(COUNT(*) AS BIGINT) AS keys, CAST(SUM(GREATEST(delivered_rows - 1, 0)) AS BIGINT) AS duplicate_rows FROM {_MATCHED_SQL} GROUP BY side",
)
def j4_zoned_texts(spark, sf_dir):
    """J4 where the scorer hands back the times as texts with and without offsets."""
    expected = normalise_keys(fx(spark, sf_dir, "fx_scoring"), ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    texts = zoned_texts(fx(spark, sf_dir, "fx_predictions_broken"), "prediction_ts", "entity_id")
    delivered = normalise_keys(texts, ["entity_id", "prediction_ts", "source_batch_id", "correlation_id"])
    return reconcile_counts(reconcile(expected, delivered))


# ---------------------------------------------------------------- J5 / J6
@register(
    "j5_one_to_one",
    """
SELECT f.entity_id, f.feature_ts, f.signal_a, f.signal_b, s.correlation_id, s.source_batch_id
FROM fx_features f JOIN fx_scoring s ON f.entity_id = s.entity_id AND f.feature_ts = s.feature_ts""",
)
def j5_one_to_one(spark, sf_dir):
    f = fx(spark, sf_dir, "fx_features")
    s = fx(spark, sf_dir, "fx_scoring").select("entity_id", "feature_ts", "correlation_id", "source_batch_id")
    return one_to_one_join(f, s, ["entity_id", "feature_ts"])


@register(
    "j6_delayed_labels",
    "SELECT s.correlation_id, s.prediction_class, s.p_class_1, t.actual_class FROM fx_scored s JOIN fx_truth t ON s.correlation_id = t.correlation_id",
)
def j6_delayed_labels(spark, sf_dir):
    return delayed_label_join(fx(spark, sf_dir, "fx_scored"), fx(spark, sf_dir, "fx_truth"))


# ---------------------------------------------------------------- S13 / S12
_MERGE_SQL = """
SELECT COALESCE(s.prediction_id, t.prediction_id) AS prediction_id,
       CASE WHEN s.prediction_id IS NOT NULL THEN s.source_batch_id ELSE t.source_batch_id END AS source_batch_id,
       CASE WHEN s.prediction_id IS NOT NULL THEN s.prediction_class ELSE t.prediction_class END AS prediction_class,
       CASE WHEN s.prediction_id IS NOT NULL THEN s.actual_quantity ELSE t.actual_quantity END AS actual_quantity,
       CASE WHEN t.prediction_id IS NOT NULL THEN t.created_at ELSE s.created_at END AS created_at,
       CASE WHEN s.prediction_id IS NOT NULL THEN s.updated_at ELSE t.updated_at END AS updated_at
FROM fx_target t FULL OUTER JOIN fx_stage s ON t.prediction_id = s.prediction_id"""


@register("s13_upsert_predictions", _MERGE_SQL)
def s13_upsert_predictions(spark, sf_dir):
    """MERGE of the staged batches into the published table, scoped to the staged batches."""
    return upsert(fx(spark, sf_dir, "fx_target"), fx(spark, sf_dir, "fx_stage"), scope="source_batch_id")


@register("s13_upsert_replay", _MERGE_SQL)
def s13_upsert_replay(spark, sf_dir):
    """Publishing the same stage twice equals publishing it once (idempotent replay).

    Runs through the partitioned Parquet table: publish the target, the stage, the stage again.
    """
    from pitloom.schemas import PREDICTIONS

    path = scratch_path(spark, "prediction-table")
    short = ["prediction_id", "source_batch_id", "prediction_class", "actual_quantity", "created_at", "updated_at"]

    def widen(frame):
        # The fixture carries a short column list; fill the rest of the 19-column contract.
        cols = {c.lower() for c in frame.columns}
        fill = []
        for f in PREDICTIONS.fields:
            name = f.name.lower()
            if name in cols:
                continue
            if name == "actual_class":
                fill.append(F.lit(None).cast("string").alias(name))
            elif f.dataType.typeName() == "timestamp_ntz":
                fill.append(F.col("created_at").alias(name))
            else:
                fill.append(F.lit("-").alias(name))
        return frame.select("*", *fill)

    for name in ("fx_target", "fx_stage", "fx_stage"):
        publish(widen(fx(spark, sf_dir, name)), path)
    return read_predictions(spark, path).select(*short)


@register(
    "s12_staged_count",
    "SELECT CAST(COUNT(*) AS BIGINT) AS expected_rows, CAST(COUNT(*) AS BIGINT) AS loaded_rows, TRUE AS complete FROM fx_predictions",
)
def s12_staged_count(spark, sf_dir):
    frame = provenance(fx(spark, sf_dir, "fx_predictions"))
    path = scratch_path(spark, "staging")
    written, _ = stage_rows(frame, path)
    loaded = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("loaded_rows"))
    return loaded.select(
        F.lit(written).cast("long").alias("expected_rows"),
        "loaded_rows",
        (F.col("loaded_rows") == F.lit(written)).alias("complete"),
    )


# ---------------------------------------------------------------- S10 monitor tables
def _tables(spark, sf_dir):
    features = fx(spark, sf_dir, "fx_scoring")
    predictions = fx(spark, sf_dir, "fx_predictions")
    spine = training_spine(spark, sf_dir).where(F.col("feature_ts").isNotNull())
    labeled = label_actuals(fx(spark, sf_dir, "fx_actuals"), CONTRACT)
    return monitor_tables(features, predictions, spine, labeled)


@register("s10_monitor_inputs", "SELECT entity_id, feature_ts, correlation_id, signal_a, signal_b FROM fx_scoring")
def s10_monitor_inputs(spark, sf_dir):
    return _tables(spark, sf_dir)["model_inputs"]


@register("s10_monitor_outputs", "SELECT entity_id, prediction_ts, correlation_id, prediction_class FROM fx_predictions")
def s10_monitor_outputs(spark, sf_dir):
    return _tables(spark, sf_dir)["model_outputs"]


@register(
    "s10_monitor_reference",
    """
SELECT a.entity_id, f.feature_ts, f.signal_a, f.signal_b,
       CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class,
       CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS prediction_class
FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '2000-06-30 00:00:00') a
ASOF JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '2000-06-30 00:00:00') f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts
WHERE f.feature_ts >= a.event_ts - INTERVAL 30 DAY""",
)
def s10_monitor_reference(spark, sf_dir):
    return _tables(spark, sf_dir)["reference"]


@register(
    "s10_monitor_ground_truth",
    "SELECT entity_id, event_ts, correlation_id, CAST(CAST(actual_quantity AS BIGINT) AS VARCHAR) AS actual_class FROM fx_actuals",
)
def s10_monitor_ground_truth(spark, sf_dir):
    return _tables(spark, sf_dir)["ground_truth"]
