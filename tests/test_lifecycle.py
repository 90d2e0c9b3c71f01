"""The lifecycle's branches: PROMOTE scores with the candidate, BLOCK skips the rest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitloom.functions.quantity import QuantityContract
from pitloom.operators.gate import MetricRule
from pitloom.plans.lifecycle import LifecycleConfig, Populations, run_lifecycle
from pitloom.schemas import ACTUALS, SCORING, TRAINING_FEATURES

T0 = dt.datetime(2024, 1, 1)


def _separable(spark, n=400):
    # The class is a function of signal_a alone, so the forest learns it well.
    feats, acts, score = [], [], []
    for i in range(n):
        e, t = f"e{i % 40}", T0 + dt.timedelta(days=i)
        a = float(i % 3) * 10.0
        feats.append((e, t, a, 1.0))
        acts.append((e, t, t + dt.timedelta(days=1), float(i % 3), f"c{i}"))
        score.append((e, t, a, 1.0, f"s{i}", "b1"))
    return Populations(
        scoring=spark.createDataFrame(score, SCORING),
        training=spark.createDataFrame(feats, TRAINING_FEATURES),
        actuals=spark.createDataFrame(acts, ACTUALS),
    )


def test_promote_path_scores_with_the_candidate(spark):
    cfg = LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01 00:00:00", scoring_cutoff="2030-01-01 00:00:00",
        contract=QuantityContract("quantity-v1", 0, 5), num_trees=10, max_depth=4,
        rules=(MetricRule("macro_f1", "maximize", 0.9, 0.0), MetricRule("log_loss", "minimize", 0.9, 0.0)),
    )
    timings = {}
    ev = {r["stage"]: r for r in run_lifecycle(spark, _separable(spark), cfg, timings=timings).collect()}
    assert ev["build_features"]["status"] == "PASS"
    assert ev["register_select"]["status"] == "SELECTED" and ev["register_select"]["reason"] == "PROMOTE"
    assert ev["invoke_batch"]["rows"] == 400 and ev["publish"]["status"] == "PUBLISHED"
    assert ev["prepare_monitor_data"]["status"] == "READY"
    assert set(timings) == set(ev)


def test_block_skips_every_later_stage(spark):
    pops = _separable(spark)
    pops.actuals = pops.actuals.withColumn("actual_quantity", F.lit(9.0))  # outside 0..5
    cfg = LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01 00:00:00", scoring_cutoff="2030-01-01 00:00:00",
        contract=QuantityContract("quantity-v1", 0, 5),
    )
    rows = run_lifecycle(spark, pops, cfg).orderBy("stage_no").collect()
    assert (rows[1]["status"], rows[1]["reason"]) == ("BLOCK", "actuals:quantity_out_of_domain")
    assert [r["status"] for r in rows[2:]] == ["SKIPPED"] * 5


def test_no_champion_and_weak_candidate_halts(spark):
    cfg = LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01 00:00:00", scoring_cutoff="2030-01-01 00:00:00",
        contract=QuantityContract("quantity-v1", 0, 5), num_trees=5, max_depth=2,
        rules=(MetricRule("macro_f1", "maximize", 1.01, 0.0),),
    )
    ev = {r["stage"]: r for r in run_lifecycle(spark, _separable(spark), cfg).collect()}
    assert ev["register_select"]["status"] == "HALTED"
    assert ev["register_select"]["reason"].endswith("no_production_deployment")
    assert ev["publish"]["status"] == "SKIPPED"


def test_label_in_scoring_source_blocks(spark):
    pops = _separable(spark)
    pops.scoring = pops.scoring.withColumn("Actual_Class", F.lit("1"))
    cfg = LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01 00:00:00", scoring_cutoff="2030-01-01 00:00:00",
        contract=QuantityContract("quantity-v1", 0, 5),
    )
    rows = run_lifecycle(spark, pops, cfg).orderBy("stage_no").collect()
    assert (rows[1]["status"], rows[1]["reason"]) == ("BLOCK", "scoring:label_leak:actual_class")


def test_two_runs_publish_into_one_table(spark):
    import tempfile

    from pitloom.sources.publish import read_predictions

    table = tempfile.mkdtemp(prefix="pitloom-table-") + "/predictions"
    cfg = LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01T00:00:00Z", scoring_cutoff="2030-01-01 00:00:00", contract=QuantityContract("quantity-v1", 0, 5),
        num_trees=5, max_depth=4, rules=(MetricRule("macro_f1", "maximize", 0.5, 0.0),), table=table, replays=1,
    )
    seen = []
    for _ in range(2):
        ev = {r["stage"]: r for r in run_lifecycle(spark, _separable(spark), cfg).collect()}
        assert ev["publish"]["rows"] == 400
        seen.append(sorted(read_predictions(spark, table).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 400


def _config(**more):
    return LifecycleConfig(
        batch_id="b1", cutoff="2030-01-01 00:00:00", scoring_cutoff="2030-01-01 00:00:00", contract=QuantityContract("quantity-v1", 0, 5),
        num_trees=5, max_depth=4, rules=(MetricRule("macro_f1", "maximize", 0.5, 0.0),), champion_class="1", **more,
    )


def test_champion_facts_reach_the_gate(spark):
    pops = _separable(spark)
    kept = {r["stage"]: r for r in run_lifecycle(spark, pops, _config(champion_measured=False)).collect()}
    assert kept["register_select"]["reason"] == "RETAIN" and kept["publish"]["rows"] == 400
    halted = {r["stage"]: r for r in run_lifecycle(spark, pops, _config(champion_mapping="quantity-v0")).collect()}
    assert (halted["register_select"]["status"], halted["register_select"]["reason"]) == ("HALTED", "mapping_version_mismatch")


def test_rows_of_another_batch_stop_the_pull(spark):
    import pytest

    pops = _separable(spark, 40)
    pops.scoring = pops.scoring.withColumn("source_batch_id", F.when(F.col("correlation_id") == "s7", "b2").otherwise("b1"))
    with pytest.raises(ValueError, match="1 scoring rows belong to another batch"):
        run_lifecycle(spark, pops, _config(single_batch=True))


def test_training_tasks_follow_the_rows():
    from pitloom.operators.scoring import training_tasks

    assert training_tasks(2_000, 2, 64 << 20, 20_000) == 8  # several tasks for a small table
    assert training_tasks(100, 2, 64 << 20, 20_000) == 1
    assert training_tasks(10**9, 64, 64 << 20, 20_000) == 8584  # by bytes
    assert training_tasks(10**12, 64, 64 << 20, 20_000) == 20_000  # bounded
