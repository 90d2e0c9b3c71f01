"""Registered queries: bounded reads, labelling and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.functions.quantity import label_actuals
from pitloom.operators.asof import FeatureSet, asof_coverage, asof_join
from pitloom.plans.registry import (
    CONTRACT,
    CUTOFF,
    LOOKBACK,
    SCORING_BATCH,
    SCORING_CUTOFF,
    SOURCE_DELAY,
    TOLERANCE,
    fx,
    register,
)
from pitloom.sources.snapshot import bounded_actuals_read, bounded_feature_read, bounded_scoring_read


def training_spine(spark, sf_dir, *, tolerance=TOLERANCE, cutoff=CUTOFF, contract=CONTRACT):
    """S2 + S3 -> F1 -> J1: the point-in-time training spine of one run."""
    features = bounded_feature_read(fx(spark, sf_dir, "fx_features"), cutoff=cutoff)
    actuals = bounded_actuals_read(fx(spark, sf_dir, "fx_actuals"), cutoff=cutoff)
    labeled = label_actuals(actuals, contract)
    return asof_join(labeled, features, tolerance=tolerance)


ORACLE_S1 = f"""
SELECT entity_id, feature_ts, signal_a, signal_b, correlation_id, source_batch_id FROM fx_scoring
WHERE source_batch_id = '{SCORING_BATCH}' AND feature_ts <= TIMESTAMP '{SCORING_CUTOFF}'"""


@register("s1_bounded_scoring_read", ORACLE_S1)
def s1_bounded_scoring_read(spark, sf_dir):
    return bounded_scoring_read(fx(spark, sf_dir, "fx_scoring"), batch_id=SCORING_BATCH, cutoff=SCORING_CUTOFF)


ORACLE_S2 = f"SELECT entity_id, feature_ts, signal_a, signal_b FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}'"


@register("s2_bounded_feature_read", ORACLE_S2)
def s2_bounded_feature_read(spark, sf_dir):
    return bounded_feature_read(fx(spark, sf_dir, "fx_features"), cutoff=CUTOFF)


ORACLE_S3 = f"""
SELECT entity_id, event_ts, label_available_ts, actual_quantity, correlation_id FROM fx_actuals
WHERE label_available_ts <= TIMESTAMP '{CUTOFF}'"""


@register("s3_bounded_actuals_read", ORACLE_S3)
def s3_bounded_actuals_read(spark, sf_dir):
    return bounded_actuals_read(fx(spark, sf_dir, "fx_actuals"), cutoff=CUTOFF)


ZONED_CUTOFF, ZONED_SCORING_CUTOFF = "2000-06-30T02:00:00+02:00", "1997-06-29T19:00:00-05:00"


def zoned_texts(frame, column, key):
    """``column`` as text: without an offset, with ``Z`` or with ``+02:00``, by a number in ``key``."""
    ts = F.col(column)
    later = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    turn = F.regexp_extract(F.col(key), "([0-9]+)", 1).cast("bigint") % 3
    return frame.withColumn(column, F.when(turn == 0, plain).when(turn == 1, F.concat(plain, F.lit("Z"))).otherwise(later))


@register("s1_zoned_texts", ORACLE_S1)
def s1_zoned_texts(spark, sf_dir):
    """S1 over a source whose times are texts with and without offsets, cut off at a time with an offset."""
    source = zoned_texts(fx(spark, sf_dir, "fx_scoring"), "feature_ts", "entity_id")
    return bounded_scoring_read(source, batch_id=SCORING_BATCH, cutoff=ZONED_SCORING_CUTOFF)


@register("s2_zoned_texts", ORACLE_S2)
def s2_zoned_texts(spark, sf_dir):
    return bounded_feature_read(zoned_texts(fx(spark, sf_dir, "fx_features"), "feature_ts", "entity_id"), cutoff=ZONED_CUTOFF)


@register("s3_zoned_texts", ORACLE_S3)
def s3_zoned_texts(spark, sf_dir):
    actuals = zoned_texts(fx(spark, sf_dir, "fx_actuals"), "event_ts", "entity_id")
    return bounded_actuals_read(zoned_texts(actuals, "label_available_ts", "correlation_id"), cutoff=ZONED_CUTOFF)


@register(
    "f1_quantity_class",
    """
SELECT entity_id, event_ts, correlation_id, actual_quantity,
       CAST(CAST(actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class,
       'quantity-v1' AS quantity_class_mapping_version
FROM fx_actuals""",
)
def f1_quantity_class(spark, sf_dir):
    actuals = fx(spark, sf_dir, "fx_actuals").select("entity_id", "event_ts", "correlation_id", "actual_quantity")
    return label_actuals(actuals, CONTRACT)


_SPINE_COLS = (
    "a.entity_id, a.event_ts, a.label_available_ts, a.actual_quantity, a.correlation_id, "
    "CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class, "
    "'quantity-v1' AS quantity_class_mapping_version"
)


def _asof_sql(condition: str, extra_where: str = "") -> str:
    feature_cols = ", ".join(
        f"CASE WHEN {condition} THEN f.{c} END AS {c}" for c in ("feature_ts", "signal_a", "signal_b")
    )
    return f"""
SELECT {_SPINE_COLS}, {feature_cols}
FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}' {extra_where}) a
ASOF LEFT JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts"""


@register("j1_asof_backward", _asof_sql("TRUE"))
def j1_asof_backward(spark, sf_dir):
    """J1 without tolerance: the latest feature row at or before each label."""
    return training_spine(spark, sf_dir, tolerance=None)


@register("j1_asof_tolerance", _asof_sql("f.feature_ts >= a.event_ts - INTERVAL 30 DAY"))
def j1_asof_tolerance(spark, sf_dir):
    """J1 with the inclusive 30-day tolerance."""
    return training_spine(spark, sf_dir)


@register(
    "j2_asof_coverage",
    f"""
SELECT CAST(COUNT(*) AS BIGINT) AS labels,
       CAST(COUNT(*) FILTER (WHERE f.feature_ts >= a.event_ts - INTERVAL 30 DAY) AS BIGINT) AS matched,
       CAST(COUNT(*) FILTER (WHERE f.feature_ts IS NULL OR f.feature_ts < a.event_ts - INTERVAL 30 DAY) AS BIGINT) AS unmatched
FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}') a
ASOF LEFT JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts""",
)
def j2_asof_coverage(spark, sf_dir):
    return asof_coverage(training_spine(spark, sf_dir))


@register(
    "j3_point_in_time_delay",
    """
SELECT a.entity_id, a.event_ts, a.correlation_id,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.feature_ts END AS feature_ts,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.signal_a END AS signal_a,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.signal_b END AS signal_b
FROM fx_actuals a
ASOF LEFT JOIN (SELECT *, feature_ts + INTERVAL 1 HOUR AS available_ts FROM fx_features) f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.available_ts""",
)
def j3_point_in_time_delay(spark, sf_dir):
    """Feature rows become visible one hour after their time; 30-day lookback."""
    labels = fx(spark, sf_dir, "fx_actuals").select("entity_id", "event_ts", "correlation_id")
    features = FeatureSet(fx(spark, sf_dir, "fx_features"), source_delay=SOURCE_DELAY, temporal_join_lookback=LOOKBACK)
    return features.retrieve(labels)


@register(
    "l0_spine_class_counts",
    f"""
SELECT CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class,
       CAST(COUNT(*) AS BIGINT) AS labels,
       CAST(COUNT(*) FILTER (WHERE f.feature_ts >= a.event_ts - INTERVAL 30 DAY) AS BIGINT) AS matched,
       CAST(ROUND(AVG(CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.signal_b END), 6) AS DOUBLE) AS mean_signal_b
FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}') a
ASOF LEFT JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts
GROUP BY 1""",
)
def spine_class_counts(spark, sf_dir):
    """The flagship: bounded reads -> class -> as-of spine -> coverage per class."""
    spine = training_spine(spark, sf_dir)
    return spine.groupBy("quantity_class").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("feature_ts").isNotNull()).alias("matched"),
        F.round(F.avg("signal_b"), 6).alias("mean_signal_b"),
    )
