"""Upsert semantics, the partitioned prediction table, replay and staging completeness."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pitloom.sources.publish import publish, read_predictions, stage_rows, upsert

T1, T2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
DDL = "prediction_id string, source_batch_id string, prediction_class string, actual_quantity double, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_upsert_keeps_id_and_created_at(spark):
    target = spark.createDataFrame([("p1", "b1", "1", 7.0, T1, T1), ("p2", "b1", "2", 7.0, T1, T1)], DDL)
    stage = spark.createDataFrame([("p2", "b1", "3", None, T2, T2), ("p3", "b2", "4", None, T2, T2)], DDL)
    got = {r["prediction_id"]: r for r in upsert(target, stage).collect()}
    assert got["p1"]["prediction_class"] == "1" and got["p1"]["updated_at"] == T1
    assert got["p2"]["prediction_class"] == "3" and got["p2"]["created_at"] == T1 and got["p2"]["updated_at"] == T2
    assert got["p2"]["actual_quantity"] is None  # replays erase actuals by default
    assert got["p3"]["created_at"] == T2
    kept = {r["prediction_id"]: r for r in upsert(target, stage, preserve=("actual_quantity",)).collect()}
    assert kept["p2"]["actual_quantity"] == 7.0


def test_scoped_upsert_equals_full(spark):
    target = spark.createDataFrame([(f"p{i}", f"b{i % 3}", "1", None, T1, T1) for i in range(30)], DDL)
    stage = spark.createDataFrame([(f"p{i}", f"b{i % 3}", "2", None, T2, T2) for i in range(0, 40, 3)], DDL)
    full = sorted(upsert(target, stage).collect())
    scoped = sorted(upsert(target, stage, scope="source_batch_id").collect())
    assert full == scoped


def _frame(spark, n, cls, batch="b1"):
    from pyspark.sql import types as T

    from pitloom.schemas import PREDICTIONS

    schema = T.StructType([T.StructField(f.name.lower(), f.dataType, True) for f in PREDICTIONS.fields])
    rows = []
    for i in range(n):
        row = {f.name: ("x" if isinstance(f.dataType, T.StringType) else None) for f in schema.fields}
        row.update(prediction_id=f"p{i}", source_batch_id=batch, prediction_class=cls, actual_class=None)
        row.update(prediction_ts=T1, created_at=T1, updated_at=T1)
        rows.append(tuple(row[f.name] for f in schema.fields))
    return spark.createDataFrame(rows, schema)


def test_publish_replaces_only_the_staged_batches(spark):
    path = tempfile.mkdtemp(prefix="pitloom-table-") + "/t"
    assert read_predictions(spark, path).count() == 0
    publish(_frame(spark, 10, "1"), path)
    first = sorted(read_predictions(spark, path).collect())
    publish(_frame(spark, 10, "1"), path)
    assert sorted(read_predictions(spark, path).collect()) == first
    publish(_frame(spark, 5, "2", batch="007"), path)
    now = read_predictions(spark, path)
    assert now.count() == 15 and sorted(now.where("source_batch_id = 'b1'").collect()) == first
    assert {r.source_batch_id for r in now.collect()} == {"b1", "007"}  # a batch id is text


def test_republishing_part_of_a_batch_keeps_the_rest_and_the_first_stamp(spark):
    path = tempfile.mkdtemp(prefix="pitloom-table-") + "/t"
    publish(_frame(spark, 6, "1"), path)
    later = _frame(spark, 3, "9").withColumn("created_at", F.lit(T2)).withColumn("updated_at", F.lit(T2))
    publish(later, path)
    got = {r.prediction_id: r for r in read_predictions(spark, path).collect()}
    assert len(got) == 6 and {r.created_at for r in got.values()} == {T1}
    assert [got[f"p{i}"].prediction_class for i in range(6)] == ["9"] * 3 + ["1"] * 3
    assert [got[f"p{i}"].updated_at for i in (0, 5)] == [T2, T1]


def test_invalid_frame_refused_before_staging(spark):
    path = tempfile.mkdtemp(prefix="pitloom-table-") + "/t"
    bad = _frame(spark, 3, "1").withColumn("prediction_id", F.lit("same"))
    with pytest.raises(ValueError, match="duplicate_prediction_id"):
        publish(bad, path)
    with pytest.raises(ValueError, match="needs a name"):
        publish(_frame(spark, 3, "1", batch=" "), path)
    assert read_predictions(spark, path).count() == 0


def test_only_a_missing_table_is_empty(spark):
    path = tempfile.mkdtemp(prefix="pitloom-table-")
    with open(f"{path}/part-0.parquet", "w") as file:
        file.write("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        read_predictions(spark, path).count()


def test_staging_counts(spark):
    df = spark.range(1000)
    written, loaded = stage_rows(df, tempfile.mkdtemp(prefix="pitloom-stage-") + "/s")
    assert written == loaded == 1000
