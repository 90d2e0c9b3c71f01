"""Bounded snapshot reads, batch stamps, manifests and snapshot folders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.identity import utc_ntz, utc_text
from pitloom.schemas import (
    ACTUALS,
    AVAILABLE_TS,
    BATCH,
    FEATURE_TS,
    SCORER_OUTPUT,
    SCORING,
    TRAINING_FEATURES,
)
from pitloom.session import configure


def cutoff_literal(cutoff: str):
    """A cutoff, with or without an offset, as a zone-less UTC timestamp."""
    return F.lit(utc_text(cutoff)).cast("timestamp_ntz")


def typed_projection(frame: DataFrame, schema: T.StructType, *, population: str) -> DataFrame:
    """P1 + P13: lower-case names, require the declared columns, cast to the declared types.

    Times become zone-less UTC: zoned ones, and texts with an offset, as the instant they name.
    """
    lowered = frame.toDF(*[c.lower() for c in frame.columns])
    missing = [f.name for f in schema.fields if f.name not in lowered.columns]
    if missing:
        raise ValueError(f"{population} is missing columns: {', '.join(missing)}")
    return lowered.select(*[_typed(lowered, f).alias(f.name) for f in schema.fields])


def _typed(frame: DataFrame, field: T.StructField):
    if isinstance(field.dataType, T.TimestampNTZType):
        return utc_ntz(F.col(field.name), frame.schema[field.name].dataType)
    return F.col(field.name).cast(field.dataType)


def bounded_scoring_read(source: DataFrame, *, batch_id: str, cutoff: str) -> DataFrame:
    """One batch, rows at or before the cutoff. The filter reaches the Parquet scan."""
    typed = typed_projection(source, SCORING, population="scoring source")
    return typed.where((F.col(BATCH) == F.lit(batch_id)) & (F.col(FEATURE_TS) <= cutoff_literal(cutoff)))


def bounded_feature_read(source: DataFrame, *, cutoff: str) -> DataFrame:
    """Training features at or before the cutoff."""
    typed = typed_projection(source, TRAINING_FEATURES, population="training feature source")
    return typed.where(F.col(FEATURE_TS) <= cutoff_literal(cutoff))


def bounded_actuals_read(source: DataFrame, *, cutoff: str) -> DataFrame:
    """S3: actuals known at the cutoff (availability clock, not event time)."""
    typed = typed_projection(source, ACTUALS, population="actuals source")
    return typed.where(F.col(AVAILABLE_TS) <= cutoff_literal(cutoff))


def parameterised_read(spark: SparkSession, query: str, args: Mapping[str, object], **frames: DataFrame) -> DataFrame:
    """S1-S3 in SQL form: named parameters are bound by Spark, never spliced into text."""
    configure(spark)
    return spark.sql(query, args=dict(args), **frames)


def batch_membership(frame: DataFrame, batch_id: str) -> DataFrame:
    """Stamp the batch where the column is absent, else count rows of other batches."""
    if BATCH not in frame.columns:
        return frame.withColumn(BATCH, F.lit(batch_id)).agg(
            F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("violations")
        )
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(BATCH).cast("string").eqNullSafe(F.lit(batch_id))).alias("violations"),
    )


def stamp_batch(frame: DataFrame, batch_id: str) -> DataFrame:
    return frame if BATCH in frame.columns else frame.withColumn(BATCH, F.lit(batch_id))


def write_snapshot(frame: DataFrame, path: str, *, partition_by: str | None = None) -> None:
    """An immutable snapshot folder; an existing folder is an error, never overwritten."""
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_sorted_snapshot(
    frame: DataFrame, path: str, *, keys: tuple[str, ...] = ("entity_id", "feature_ts"), files: int | None = None
) -> None:
    """O1: snapshot laid out by key range and sorted within each file.

    The reference sorts the whole frame; in Spark order is not a property of a table,
    so this only sets the layout (range partitions by key, sorted inside), which keeps
    min/max statistics tight for later key-range reads.
    """
    n = files or frame.sparkSession.sparkContext.defaultParallelism
    frame.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every Parquet file below ``path``, by name; an empty folder is an empty frame."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def write_scorer_csv(frame: DataFrame, path: str) -> None:
    """Headerless CSV, five text columns by position (the scorer hand-off format)."""
    frame.select(*[F.col(f.name).cast("string") for f in SCORER_OUTPUT.fields]).write.mode(
        "errorifexists"
    ).option("header", "false").csv(path)


def read_scorer_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so that ids such as ``007`` keep their leading zeros. A row of more or fewer columns fails."""
    return spark.read.schema(SCORER_OUTPUT).option("header", "false").option("mode", "FAILFAST").csv(path)


def read_scoring_input(spark: SparkSession, paths: list[str], schema: T.StructType = SCORING) -> DataFrame:
    """Parquet or CSV (with header) by suffix, in the declared columns and types, one after another.

    A CSV row of more or fewer columns than its header, or a value that is none of its column's type, fails.
    """
    if not paths:
        raise ValueError("a scoring run needs input files")
    out = None
    for path in paths:
        if path.lower().rstrip("/").endswith(".csv"):
            header = spark.read.option("header", "true").csv(path).columns
            texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
            found = spark.read.schema(texts).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
        else:
            found = spark.read.parquet(path)
        typed = typed_projection(found, schema, population=f"scoring input {path}")
        out = typed if out is None else out.unionByName(typed)
    return out


def source_manifest(
    populations: Mapping[str, DataFrame],
    queries: Mapping[str, str],
    *,
    batch_id: str,
    cutoff: str,
    event_id: str,
    created_at: str,
) -> DataFrame:
    """S7 + A1: row count per population and SHA-256 of each query text, one row.

    Each population is counted by its own (partial) aggregate; the one-row counts
    are unioned and folded into columns.
    """
    counts = None
    for name, frame in populations.items():
        counted = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("population"), "n")
        counts = counted if counts is None else counts.unionByName(counted)
    out = counts.agg(
        *[F.max(F.when(F.col("population") == name, F.col("n"))).alias(f"{name}_rows") for name in populations]
    )
    cols = [F.col(c) for c in out.columns]
    for name, text in queries.items():
        cols.append(F.sha2(F.lit(text), 256).alias(f"{name}_query_sha256"))
    cols += [
        F.lit(batch_id).alias(BATCH),
        F.lit(cutoff).alias("source_cutoff"),
        F.lit(event_id).alias("source_event_id"),
        F.lit(created_at).alias("created_at"),
    ]
    return out.select(*cols)
