"""Staged, complete, idempotent publication of predictions on plain Parquet.

``upsert`` is the MERGE: matched keys take every staged column except the kept
ones (``prediction_id``, ``created_at``); new keys are inserted; other target rows
stay. With ``scope`` (the batch column) only target rows of the staged batches take
part in the join; the rest pass through untouched. That is exact when the key is
derived from the batch, as prediction ids are.

``publish`` stages, checks, merges and replaces whole batches by Spark's dynamic
partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.operators.contracts import prediction_contract_rules
from pitloom.schemas import BATCH, PREDICTION_COLUMNS, PREDICTIONS
from pitloom.session import scratch_path

KEEP = ("prediction_id", "created_at")


def upsert(
    target: DataFrame,
    stage: DataFrame,
    *,
    key: str = "prediction_id",
    keep: Sequence[str] = KEEP,
    preserve: Sequence[str] = (),
    scope: str | None = None,
) -> DataFrame:
    """The merged table (target column order).

    ``preserve`` lists columns whose target value survives when the staged value is
    null (e.g. actuals that arrived after the first publication).
    """
    cols = target.columns
    if scope is not None:
        batches = stage.select(scope).distinct()
        touched = target.join(batches, scope, "left_semi")
        untouched = target.join(batches, scope, "left_anti")
        return _merge(touched, stage, cols, key, keep, preserve).unionByName(untouched)
    return _merge(target, stage, cols, key, keep, preserve)


def _merge(target, stage, cols, key, keep, preserve):
    t, s = target.alias("t"), stage.alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    staged = F.col(f"s.{key}").isNotNull()
    out = []
    for c in cols:
        tc, sc = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c == key:
            value = F.coalesce(sc, tc)
        elif c in keep:
            value = F.when(tc.isNotNull() | F.col(f"t.{key}").isNotNull(), tc).otherwise(sc)
        elif c in preserve:
            value = F.when(staged, F.coalesce(sc, tc)).otherwise(tc)
        else:
            value = F.when(staged, sc).otherwise(tc)
        out.append(value.alias(c))
    return joined.select(*out)


def stage_rows(frame: DataFrame, path: str) -> tuple[int, int]:
    """Write the staging copy while counting it, then count what landed."""
    obs = Observation("staged")
    frame.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    written = int(obs.get["rows"])
    loaded = frame.sparkSession.read.parquet(path).count()
    return written, loaded


def require_valid_predictions(frame: DataFrame) -> DataFrame:
    """P11 as a gate: any null required column or repeated id fails before staging."""
    failing = prediction_contract_rules(frame).where(F.col("violations") > 0).limit(1).collect()
    if failing:
        r = failing[0]
        raise ValueError(f"not published: {r['violations']} row(s) break {r['rule']}")
    upper = frame.toDF(*[c.upper() for c in frame.columns]).select(*PREDICTION_COLUMNS)
    return upper.toDF(*[c.lower() for c in upper.columns])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The published table by its declared schema; a table that is not there yet is empty, any other failure is one."""
    fields = [T.StructField(f.name.lower(), f.dataType, True) for f in PREDICTIONS.fields]
    batch = next(f for f in fields if f.name == BATCH)
    schema = T.StructType([f for f in fields if f.name != BATCH] + [batch])  # the partition column comes last
    columns = [c.lower() for c in PREDICTION_COLUMNS]
    try:
        return spark.read.schema(schema).parquet(path).select(*columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select(*columns)


def publish(frame: DataFrame, path: str, *, preserve: Sequence[str] = ()) -> dict:
    """S12 + S13: validate, stage with a completeness check, merge, and replace the staged batches in the table at ``path``.

    The table is plain Parquet partitioned by batch, and each staged batch is replaced as a whole by Spark's dynamic
    partition overwrite: other batches are neither read nor written, and a replay writes the same rows again. The merged rows
    are written to the shared folder first, so that nothing is overwritten while it is read, and a run that fails on the way
    leaves the table as it was or, stopped between two batches of one publication, with the first of them replaced; running
    it again completes it. (With a catalog whose tables know MERGE INTO, the same statement is one transaction.)
    """
    spark = frame.sparkSession
    valid = require_valid_predictions(frame)
    staging = scratch_path(spark, "staging")
    written, loaded = stage_rows(valid, staging)
    if written != loaded:
        raise RuntimeError(f"only {loaded} of {written} staged predictions can be read back")
    staged = spark.read.schema(valid.schema).parquet(staging)
    batches = staged.select(BATCH).distinct()
    unnamed = batches.where(F.trim(BATCH) == "").limit(1).count()
    if unnamed:
        raise ValueError("a prediction batch needs a name: it is a folder of the table")
    before = read_predictions(spark, path).join(batches, BATCH, "left_semi")
    merged_path = scratch_path(spark, "merged")
    upsert(before, staged, preserve=preserve).write.parquet(merged_path)
    merged = spark.read.schema(staged.schema).parquet(merged_path)
    # Rebalancing gathers a batch's rows into few files, and splits a large batch over tasks.
    merged.hint("rebalance", BATCH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)
    return {"status": "PUBLISHED", "published_rows": loaded}
