"""Complete-batch reconciliation and checked joins.

Reconciliation stacks both sides and groups once by the key (map-side partial
counts, so a hot key costs one row per task). Duplicate deliveries, missing and
extra keys all come out of that one aggregate, with no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.functions.identity import utc_ntz
from pitloom.functions.quantity import ContractViolation

KEYS = ("entity_id", "prediction_ts", "source_batch_id", "correlation_id")
BOTH, LEFT_ONLY, RIGHT_ONLY = "both", "left_only", "right_only"


def normalise_keys(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rename to the four key names; ids as text, the time as the instant it names, in zone-less UTC."""
    e, t, b, c = columns
    return frame.select(
        F.col(e).cast("string").alias("entity_id"),
        utc_ntz(F.col(t), frame.schema[t].dataType).alias("prediction_ts"),
        F.col(b).cast("string").alias("source_batch_id"),
        F.col(c).cast("string").alias("correlation_id"),
    )


def reconcile(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Match expected and delivered keys; null keys match each other (as in a pandas merge).

    Both sides are stacked with a side marker and grouped once by the four keys: one
    shuffle, map-side partial counts, and no join. Output per key: the four keys,
    ``side`` (both / left_only / right_only), ``expected_rows`` and ``delivered_rows``.
    """
    stacked = expected.select(*KEYS, F.lit(1).alias("__e"), F.lit(0).alias("__d")).unionByName(
        delivered.select(*KEYS, F.lit(0).alias("__e"), F.lit(1).alias("__d"))
    )
    per_key = stacked.groupBy(*KEYS).agg(
        F.sum("__e").alias("expected_rows"), F.sum("__d").alias("delivered_rows")
    )
    side = (
        F.when((F.col("expected_rows") > 0) & (F.col("delivered_rows") > 0), F.lit(BOTH))
        .when(F.col("expected_rows") > 0, F.lit(LEFT_ONLY))
        .otherwise(F.lit(RIGHT_ONLY))
    )
    return per_key.select(*KEYS, side.alias("side"), "expected_rows", "delivered_rows")


def reconcile_counts(matched: DataFrame) -> DataFrame:
    """Keys per side, and surplus (duplicate) deliveries per side."""
    return matched.groupBy("side").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.greatest(F.col("delivered_rows") - 1, F.lit(0))).alias("duplicate_rows"),
    )


def missing_and_extra(matched: DataFrame) -> DataFrame:
    """Keys that are not on both sides."""
    return matched.where(F.col("side") != BOTH).select(*KEYS, "side")


def require_complete(matched: DataFrame) -> None:
    """Fail unless every key is on both sides exactly once (one small aggregate).

    Both sides are checked for repeated keys: the reference checks only the predictions.
    """
    row = matched.agg(
        F.count_if(F.col("side") == LEFT_ONLY).alias("left_only"),
        F.count_if(F.col("side") == RIGHT_ONLY).alias("right_only"),
        F.coalesce(F.sum(F.greatest(F.col("delivered_rows") - 1, F.lit(0))), F.lit(0)).alias("dup"),
        F.coalesce(F.sum(F.greatest(F.col("expected_rows") - 1, F.lit(0))), F.lit(0)).alias("expected_dup"),
    ).first()
    if row["expected_dup"]:
        raise ValueError(f"{row['expected_dup']} scoring rows repeat the key of another one")
    if row["dup"]:
        raise ValueError(f"{row['dup']} predictions were delivered more than once")
    if row["left_only"] or row["right_only"]:
        raise ValueError(
            f"incomplete delivery: {row['left_only']} rows without a prediction, {row['right_only']} predictions without a row"
        )


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that refuses a key repeated on either side (both sides checked by one grouped job before joining)."""
    sides = left.select(*keys, F.lit("left").alias("__side")).unionByName(right.select(*keys, F.lit("right").alias("__side")))
    repeated = sides.groupBy(*keys, "__side").count().where(F.col("count") > 1).select("__side").limit(1).collect()
    if repeated:
        raise ContractViolation(f"{repeated[0]['__side']} side repeats a join key; one-to-one join refused")
    return left.join(right, list(keys), "inner")


def delayed_label_join(predictions: DataFrame, truth: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Predictions with their late-arriving label (inner; only labelled rows)."""
    return predictions.join(truth, key, "inner")


def label_coverage(predictions: DataFrame, truth: DataFrame, key: str = "correlation_id") -> DataFrame:
    """J6 (left form): how many predictions have a label yet."""
    flagged = predictions.join(truth.select(key).distinct().withColumn("__labelled", F.lit(True)), key, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("__labelled")).alias("labelled"),
    )
