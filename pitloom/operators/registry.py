"""M4: the candidate registry as a table (model, version, mapping, one column per metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_rows(
    candidates: DataFrame, metrics: DataFrame, model_name: str, metric_names: Sequence[str]
) -> DataFrame:
    """Candidates with their metrics pivoted to ``metric_<name>`` columns.

    The pivot values are given, so the pivot is one aggregation without a
    distinct-values pass. A metric the candidate lacks stays null (a failure for
    the gate, never a pass).
    """
    wide = (
        metrics.groupBy("model_version", "segment")
        .pivot("metric", list(metric_names))
        .agg(F.first("value"))
    )
    for m in metric_names:
        wide = wide.withColumnRenamed(m, f"metric_{m}")
    return candidates.join(wide, ["model_version", "segment"], "left").select(
        F.lit(model_name).alias("model_name"),
        "model_version",
        "segment",
        "mapping_version",
        *[f"metric_{m}" for m in metric_names],
        F.lit("candidate").alias("lifecycle"),
    )


def append_registry(rows: DataFrame, path: str) -> None:
    """Append candidates to the registry table (one Parquet folder, partitioned by model)."""
    rows.write.mode("append").partitionBy("model_name").parquet(path)
