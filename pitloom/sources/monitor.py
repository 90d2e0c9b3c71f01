"""The four monitor tables (model inputs, model outputs, reference, ground truth)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.schemas import FEATURES

MONITOR_TABLES = ("model_inputs", "model_outputs", "reference", "ground_truth")


def monitor_tables(
    features: DataFrame, predictions: DataFrame, training: DataFrame, labeled_actuals: DataFrame
) -> dict[str, DataFrame]:
    """Projections only; the reference side is the training spine with its class as prediction."""
    return {
        "model_inputs": features.select("entity_id", "feature_ts", "correlation_id", *FEATURES),
        "model_outputs": predictions.select("entity_id", "prediction_ts", "correlation_id", "prediction_class"),
        "reference": training.select(
            "entity_id", "feature_ts", *FEATURES, "quantity_class", F.col("quantity_class").alias("prediction_class")
        ),
        "ground_truth": labeled_actuals.select(
            "entity_id", "event_ts", "correlation_id", F.col("quantity_class").alias("actual_class")
        ),
    }


def write_monitor_tables(tables: Mapping[str, DataFrame], root: str, *, published: bool) -> dict:
    """Write the four tables (READY), or nothing when no batch was published (SKIPPED).

    Returns the manifest with the row count of each table, counted while writing.
    """
    from pyspark.sql import Observation

    if not published:
        return {"status": "SKIPPED", "reason": "no published batch"}
    from pitloom.operators.contracts import require_unique_ids

    # The monitor joins outputs and ground truth on the business id: both must be unique.
    require_unique_ids(tables["model_outputs"], "correlation_id", population="model outputs")
    require_unique_ids(tables["ground_truth"], "correlation_id", population="ground truth")
    manifest: dict[str, object] = {"status": "READY"}
    for name in MONITOR_TABLES:
        obs = Observation(name)
        tables[name].observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{root}/{name}")
        manifest[f"{name}_rows"] = int(obs.get["rows"])
    return manifest
