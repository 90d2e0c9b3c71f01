"""Registered queries: training, batch scoring and the scorer plug point."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.operators.reconcile import normalise_keys, reconcile, reconcile_counts
from pitloom.operators.scoring import batch_score, train_classifier
from pitloom.plans.registry import RUN_TS, fx, register

SEED = 17


def embedding_population(spark, sf_dir):
    """``embeddings`` as a scoring population: key columns around the vector and its class."""
    e = fx(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("entity_id"),
        F.lit(RUN_TS).cast("timestamp_ntz").alias("feature_ts"),
        F.lit("embeddings").alias("source_batch_id"),
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("correlation_id"),
        "embedding",
        F.col("label").cast("string").alias("quantity_class"),
    )


def trained(spark, sf_dir):
    pop = embedding_population(spark, sf_dir)
    return train_classifier(pop, features="embedding", label="quantity_class", key=["correlation_id"], seed=SEED), pop


@register("m1_train_metrics")
def m1_train_metrics(spark, sf_dir):
    """Random forest (160 trees, depth 12, seed 17) on a stratified 25 % hold-out; rows-only check."""
    result, _ = trained(spark, sf_dir)
    return result.metrics


@register("m3_batch_scores")
def m3_batch_scores(spark, sf_dir):
    """Scores of the whole population in the five-column scorer contract; rows-only check."""
    result, pop = trained(spark, sf_dir)
    return batch_score(result.model, pop, features="embedding")


@register(
    "m3_scored_keys",
    "SELECT 'both' AS side, CAST(COUNT(*) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS duplicate_rows FROM embeddings",
)
def m3_scored_keys(spark, sf_dir):
    """Every scoring key comes back exactly once from the scorer (J4 over M3's output)."""
    result, pop = trained(spark, sf_dir)
    scored = batch_score(result.model, pop, features="embedding")
    expected = normalise_keys(pop, ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    delivered = normalise_keys(scored, ["entity_id", "prediction_ts", "source_batch_id", "correlation_id"])
    return reconcile_counts(reconcile(expected, delivered))
