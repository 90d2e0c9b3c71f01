"""Snapshot folders, the scorer CSV, mixed scoring inputs and the pandas model plug point."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest

import pandas as pd
from pyspark.sql import functions as F

from pitloom.operators.asof import FeatureSet
from pitloom.operators.scoring import score_with_pandas
from pitloom.schemas import SCORER_OUTPUT, TRAINING_FEATURES, SCORING
from pitloom.sources import snapshot as S

T0 = dt.datetime(2024, 1, 1)


def test_empty_snapshot_folder_reads_as_empty(spark):
    d = tempfile.mkdtemp(prefix="pitloom-empty-")
    df = S.read_snapshot(spark, d, TRAINING_FEATURES)
    assert df.count() == 0 and df.schema == TRAINING_FEATURES


def test_sorted_snapshot_roundtrip(spark):
    rows = [(f"e{i % 5}", T0 + dt.timedelta(days=i), float(i), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, TRAINING_FEATURES)
    d = tempfile.mkdtemp(prefix="pitloom-snap-") + "/s"
    S.write_sorted_snapshot(df, d, files=4)
    assert sorted(S.read_snapshot(spark, d, TRAINING_FEATURES).collect()) == sorted(df.collect())


def test_scorer_csv_keeps_leading_zeros(spark):
    rows = [("007", "2024-01-01 00:00:00", "b1", "0010", "3")]
    d = tempfile.mkdtemp(prefix="pitloom-csv-") + "/p"
    S.write_scorer_csv(spark.createDataFrame(rows, SCORER_OUTPUT), d)
    got = S.read_scorer_csv(spark, d).first()
    assert (got["entity_id"], got["correlation_id"]) == ("007", "0010")


def _kilns(n, first=0):
    return [(f"kiln-{i}", T0 + dt.timedelta(hours=i), 700.0 + i, 0.5 * i, f"firing-{i}", "spring") for i in range(first, first + n)]


def test_scoring_inputs_of_both_kinds(spark):
    root = tempfile.mkdtemp(prefix="pitloom-mixed-")
    spark.createDataFrame(_kilns(3), SCORING).write.parquet(f"{root}/one.parquet")
    other = spark.createDataFrame(_kilns(2, 10), SCORING).select("signal_b", "entity_id", "feature_ts", "source_batch_id", "signal_a", "correlation_id")
    other.write.option("header", "true").csv(f"{root}/two.csv")
    df = S.read_scoring_input(spark, [f"{root}/one.parquet", f"{root}/two.csv"])
    assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in SCORING.fields]
    assert sorted(map(tuple, df.collect())) == sorted(_kilns(3) + _kilns(2, 10))


@pytest.mark.parametrize("line", ["kiln-1,2024-01-01T00:00:00,1.0,2.0,firing-1", "kiln-1,2024-01-01T00:00:00,1.0,2.0,firing-1,spring,more", "kiln-1,2024-01-01T00:00:00,hot,2.0,firing-1,spring"])
def test_broken_scoring_rows_are_refused(spark, line):
    path = tempfile.mkdtemp(prefix="pitloom-broken-") + "/in.csv"
    with open(path, "w") as file:
        file.write("entity_id,feature_ts,signal_a,signal_b,correlation_id,source_batch_id\n" + line + "\n")
    with pytest.raises(Exception, match="(?i)malformed|CAST_INVALID"):
        S.read_scoring_input(spark, [path]).collect()


def test_broken_scorer_rows_are_refused(spark):
    path = tempfile.mkdtemp(prefix="pitloom-broken-")
    with open(f"{path}/part.csv", "w") as file:
        file.write("kiln-1,2024-01-01 00:00:00,spring,firing-1,3\nkiln-2,2024-01-01 00:00:00,spring\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_scorer_csv(spark, path).collect()


def test_batch_membership(spark):
    df = spark.createDataFrame([("b1",), ("b2",), (None,)], "source_batch_id string")
    r = S.batch_membership(df, "b1").first()
    assert (r["rows"], r["violations"]) == (3, 2)
    assert S.batch_membership(spark.createDataFrame([(1,)], "x int"), "b1").first()["violations"] == 0


def test_feature_set_retrieval_respects_delay(spark):
    feats = spark.createDataFrame([("e", T0, 1.0, 1.0)], TRAINING_FEATURES)
    labels = spark.createDataFrame(
        [("e", T0 + dt.timedelta(minutes=30), 1), ("e", T0 + dt.timedelta(hours=2), 2)], "entity_id string, event_ts timestamp_ntz, lid int"
    )
    got = {r["lid"]: r["signal_a"] for r in FeatureSet(feats).retrieve(labels).collect()}
    assert got == {1: None, 2: 1.0}  # visible one hour after its time


def test_pandas_model_plug_point(spark):
    df = spark.createDataFrame(
        [("e1", T0, "b1", "c1", 1.0, 5.0), ("e2", T0, "b1", "c2", 9.0, 1.0)],
        "entity_id string, feature_ts timestamp_ntz, source_batch_id string, correlation_id string, signal_a double, signal_b double",
    )

    def predict(x: pd.DataFrame) -> pd.Series:
        return (x["signal_a"] > x["signal_b"]).astype(int)

    out = score_with_pandas(df, predict, features=["signal_a", "signal_b"])
    assert out.columns == ["entity_id", "prediction_ts", "source_batch_id", "correlation_id", "prediction_class"]
    assert {r["entity_id"]: r["prediction_class"] for r in out.collect()} == {"e1": "0", "e2": "1"}
    assert out.where(F.col("prediction_ts").isNull()).count() == 0


def test_a_batch_without_a_feature_is_not_scored(spark):
    from pitloom.operators.scoring import batch_score

    df = spark.createDataFrame(_kilns(2), SCORING).drop("signal_b")
    for score in (batch_score, score_with_pandas):
        with pytest.raises(ValueError, match="needs signal_b"):
            score(*([None, df] if score is batch_score else [df, lambda x: x["signal_a"]]), features=["signal_a", "signal_b"])


@pytest.mark.parametrize(("ids", "rule"), [(["f-1", None], "blank"), (["f-1", "\t "], "blank"), (["f-1", "f-2", "f-1"], "duplicate")])
def test_monitor_ids(spark, ids, rule):
    from pitloom.operators.contracts import require_unique_ids

    df = spark.createDataFrame([(i,) for i in ids], "firing string")
    with pytest.raises(ValueError, match=f"outputs: rule {rule}_firing"):
        require_unique_ids(df, "firing", population="outputs")
    require_unique_ids(df.where("firing = 'f-2'"), "firing", population="outputs")


def test_an_incomplete_or_repeated_delivery_is_refused(spark):
    from pitloom.operators.reconcile import normalise_keys, reconcile, require_complete

    rows = spark.createDataFrame(_kilns(4), SCORING)
    keys = ["entity_id", "feature_ts", "source_batch_id", "correlation_id"]
    expected = normalise_keys(rows, keys)
    require_complete(reconcile(expected, expected))
    autumn = normalise_keys(rows.withColumn("source_batch_id", F.when(F.col("signal_b") < 1, "autumn").otherwise(F.col("source_batch_id"))), keys)
    with pytest.raises(ValueError, match="incomplete delivery: 2 rows without a prediction, 2 predictions without a row"):
        require_complete(reconcile(expected, autumn))
    with pytest.raises(ValueError, match="4 predictions were delivered more than once"):
        require_complete(reconcile(expected, expected.unionAll(expected)))
    with pytest.raises(ValueError, match="4 scoring rows repeat"):
        require_complete(reconcile(expected.unionAll(expected), expected))
