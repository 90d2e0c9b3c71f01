"""Declared schemas of the populations and the published prediction table."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = "entity_id"
FEATURE_TS = "feature_ts"
LABEL_TS = "event_ts"
AVAILABLE_TS = "label_available_ts"
CORRELATION = "correlation_id"
BATCH = "source_batch_id"
QUANTITY = "actual_quantity"
FEATURES = ("signal_a", "signal_b")

# Column names that must never reach a scoring population (label leak).
LABEL_COLUMNS = ("actual_class", "actual_quantity", "quantity_class", "quantity_value", "target")

SCORING = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField(FEATURE_TS, T.TimestampNTZType()),
        T.StructField("signal_a", T.DoubleType()),
        T.StructField("signal_b", T.DoubleType()),
        T.StructField(CORRELATION, T.StringType()),
        T.StructField(BATCH, T.StringType()),
    ]
)

TRAINING_FEATURES = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField(FEATURE_TS, T.TimestampNTZType()),
        T.StructField("signal_a", T.DoubleType()),
        T.StructField("signal_b", T.DoubleType()),
    ]
)

ACTUALS = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField(LABEL_TS, T.TimestampNTZType()),
        T.StructField(AVAILABLE_TS, T.TimestampNTZType()),
        T.StructField(QUANTITY, T.DoubleType()),
        T.StructField(CORRELATION, T.StringType()),
    ]
)

# Scorer output: five text columns by position (headerless CSV in the reference).
SCORER_OUTPUT = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField("prediction_ts", T.StringType()),
        T.StructField(BATCH, T.StringType()),
        T.StructField(CORRELATION, T.StringType()),
        T.StructField("prediction_class", T.StringType()),
    ]
)

# The 19-column published prediction contract, in table order.
PREDICTION_COLUMNS = (
    "PREDICTION_ID",
    "SOURCE_BATCH_ID",
    "ENTITY_ID",
    "CORRELATION_ID",
    "PREDICTION_TS",
    "AML_PIPELINE_JOB_ID",
    "MLFLOW_RUN_ID",
    "FEATURE_SET_NAME",
    "FEATURE_SET_VERSION",
    "MODEL_NAME",
    "MODEL_VERSION",
    "BATCH_ENDPOINT_NAME",
    "BATCH_DEPLOYMENT_NAME",
    "QUANTITY_CLASS_MAPPING_VERSION",
    "PREDICTION_CLASS",
    "ACTUAL_QUANTITY",
    "ACTUAL_CLASS",
    "CREATED_AT",
    "UPDATED_AT",
)
NULLABLE_PREDICTION_COLUMNS = ("ACTUAL_QUANTITY", "ACTUAL_CLASS")
# Never overwritten by an upsert.
MERGE_KEEP = ("PREDICTION_ID", "CREATED_AT")


def _prediction_type(name: str) -> T.DataType:
    if name == "ACTUAL_QUANTITY":
        return T.DoubleType()
    if name in ("PREDICTION_TS", "CREATED_AT", "UPDATED_AT"):
        return T.TimestampNTZType()
    return T.StringType()


PREDICTIONS = T.StructType(
    [
        T.StructField(c, _prediction_type(c), c in NULLABLE_PREDICTION_COLUMNS)
        for c in PREDICTION_COLUMNS
    ]
)
