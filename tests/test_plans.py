"""Plan checks on Parquet snapshots: pushdown, pruning, and the shuffle shape of the operators."""

from __future__ import annotations

import datetime as dt
import io
import re
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from pitloom.operators.asof import asof_join
from pitloom.operators.digest import snapshot_digest
from pitloom.operators.reconcile import normalise_keys, reconcile
from pitloom.schemas import ACTUALS, SCORING, TRAINING_FEATURES
from pitloom.sources import snapshot as S

T0 = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _exchanges(plan: str) -> int:
    tree = plan.split("\n\n")[0]
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange \(", tree))


@pytest.fixture(scope="module")
def snapshots(spark):
    root = tempfile.mkdtemp(prefix="pitloom-plans-")
    feats = [(f"e{i % 50}", T0 + dt.timedelta(days=i), float(i), 1.0) for i in range(500)]
    acts = [(f"e{i % 50}", T0 + dt.timedelta(days=i, hours=3), T0 + dt.timedelta(days=i + 30), float(i % 5), f"c{i}") for i in range(500)]
    scoring = [(f"e{i % 50}", T0 + dt.timedelta(days=i), float(i), 1.0, f"s{i}", f"b{i % 3}") for i in range(500)]
    spark.createDataFrame(feats, TRAINING_FEATURES).write.parquet(f"{root}/features")
    spark.createDataFrame(acts, ACTUALS).write.parquet(f"{root}/actuals")
    spark.createDataFrame(scoring, SCORING).write.parquet(f"{root}/scoring")
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("features", "actuals", "scoring")}


def test_bounded_read_pushes_cutoff_and_prunes(snapshots):
    plan = _plan(S.bounded_scoring_read(snapshots["scoring"], batch_id="b1", cutoff="2024-06-01 00:00:00").select("entity_id"))
    assert "LessThanOrEqual(feature_ts,2024-06-01T00:00)" in plan
    assert "EqualTo(source_batch_id,b1)" in plan
    assert "ReadSchema: struct<entity_id:string,feature_ts:timestamp_ntz,source_batch_id:string>" in plan


def test_parameterised_read_binds_named_arguments(spark, snapshots):
    df = S.parameterised_read(
        spark, "SELECT entity_id FROM {src} WHERE source_batch_id = :batch", {"batch": "b2"}, src=snapshots["scoring"]
    )
    assert df.count() == 166
    assert "EqualTo(source_batch_id,b2)" in _plan(df)


def test_asof_join_shape(spark, snapshots):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    spine = asof_join(snapshots["actuals"], snapshots["features"], tolerance="30 days")
    plan = _plan(spine)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before  # building and explaining runs no job
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # Whole label rows are read by the last join alone; all other scans are narrow.
    wide = re.findall(r"ReadSchema: struct<[^>]*correlation_id[^>]*>", plan)
    assert len(wide) == 1, plan


def test_reconcile_is_one_grouped_shuffle(snapshots):
    exp = normalise_keys(snapshots["scoring"], ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    got = normalise_keys(snapshots["scoring"], ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    plan = _plan(reconcile(exp, got))
    assert _exchanges(plan) == 1
    assert "Join" not in plan.split("\n\n")[0]


def test_digest_is_map_side_then_one_final_aggregate(snapshots):
    plan = _plan(snapshot_digest(snapshots["features"]))
    assert _exchanges(plan) == 1
    assert "Sort" not in plan.split("\n\n")[0]


def test_bounded_features_need_no_shuffle(snapshots):
    plan = _plan(S.bounded_feature_read(snapshots["features"], cutoff="2024-03-01 00:00:00").where(F.col("signal_a") > 1))
    assert _exchanges(plan) == 0
