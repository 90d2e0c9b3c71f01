"""L1 / L2: the lifecycle as one Spark job over DataFrames, with one evidence row per stage.

pull -> build_features -> train -> register_select -> invoke_batch -> publish ->
prepare_monitor_data. A stage runs only on the positive status of the one before;
otherwise it records SKIPPED. Materialisation (Parquet under the shared folder)
happens only where evidence must be immutable: after pull, after the spine,
after scoring, with the prediction ids and at publication. Control leaves the driver only at actions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.fixtures import fixture
from pitloom.functions.quantity import QuantityContract, label_actuals
from pitloom.operators.asof import asof_join
from pitloom.operators.contracts import decision
from pitloom.operators.digest import snapshot_digest
from pitloom.operators.gate import MetricRule, gate_outcome, gate_reasons, selected_model
from pitloom.operators.reconcile import normalise_keys, reconcile, require_complete
from pitloom.operators.scoring import batch_score, constant_baseline, train_classifier
from pitloom.schemas import SCORING, TRAINING_FEATURES, ACTUALS
from pitloom.session import configure, scratch_path
from pitloom.sources.monitor import monitor_tables, write_monitor_tables
from pitloom.sources.publish import publish, read_predictions
from pitloom.sources.snapshot import (
    batch_membership,
    bounded_actuals_read,
    bounded_feature_read,
    bounded_scoring_read,
    read_scorer_csv,
    read_snapshot,
    stamp_batch,
    write_scorer_csv,
    write_snapshot,
)

EVIDENCE = T.StructType(
    [
        T.StructField("stage_no", T.IntegerType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)


@dataclass
class LifecycleConfig:
    batch_id: str
    cutoff: str
    scoring_cutoff: str
    tolerance: str = "30 days"
    contract: QuantityContract = field(default_factory=lambda: QuantityContract("quantity-v1", 0, 20))
    rules: tuple[MetricRule, ...] = (
        MetricRule("macro_f1", "maximize", 0.70, 0.01),
        MetricRule("log_loss", "minimize", 0.90, 0.0),
    )
    seed: int = 17
    num_trees: int = 160
    max_depth: int = 12
    model_name: str = "quantity-classifier"
    champion_class: str | None = None  # constant-class champion (M2); None: no production model
    champion_mapping: str | None = None  # the mapping the champion was trained with; None: the run's own
    champion_measured: bool = True  # False: the champion serves, but nothing was measured of it
    run_ts: str = "2026-03-01 00:00:00"
    event_id: str = "manual"
    table: str | None = None  # the published table; None: one of the run's own
    single_batch: bool = False  # the scoring source holds one batch: stamp it, or refuse rows of another
    replays: int = 0  # publications repeated, as after a lost answer; the table must not change


@dataclass
class Populations:
    scoring: DataFrame
    training: DataFrame
    actuals: DataFrame


def _evidence(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    # One row per stage (seven rows): the evidence is metadata, not data.
    return spark.createDataFrame(rows, EVIDENCE)


def run_lifecycle(
    spark: SparkSession, sources: Populations, cfg: LifecycleConfig, timings: dict | None = None
) -> DataFrame:
    """Run every stage; returns the stage evidence (L2). ``timings`` receives seconds per stage."""
    import time

    configure(spark)
    run_dir = scratch_path(spark, "lifecycle")
    ev: list[tuple] = []
    started = [time.perf_counter()]

    class _Evidence(list):
        def append(self, row):  # stamp the time spent since the previous stage
            now = time.perf_counter()
            if timings is not None:
                timings[row[1]] = round(now - started[0], 3)
            started[0] = now
            super().append(row)

    ev = _Evidence()
    stages = ["pull", "build_features", "train", "register_select", "invoke_batch", "publish", "prepare_monitor_data"]

    def skip_rest(from_no: int, reason: str) -> DataFrame:
        for i in range(from_no, len(stages)):
            ev.append((i + 1, stages[i], "SKIPPED", reason, 0))
        return _evidence(spark, ev)

    # Every job of the run carries a tag naming the run's batch, cutoff and event (S1's
    # query tag), so the run can be found in the event log or stopped with interruptTag.
    tag = f"pitloom-run:{cfg.batch_id}:{cfg.cutoff}:{cfg.event_id}".replace(",", ";")
    spark.addTag(tag)
    try:
        return _run_stages(spark, sources, cfg, run_dir, ev, skip_rest)
    finally:
        spark.removeTag(tag)


def _run_stages(spark, sources, cfg, run_dir, ev, skip_rest):
    # 1. pull: bounded reads, immutable snapshots.
    # A source without a batch column holds the requested batch alone; one with it must hold nothing else.
    source = stamp_batch(sources.scoring, cfg.batch_id) if cfg.single_batch else sources.scoring
    if cfg.single_batch:
        strays = batch_membership(source, cfg.batch_id).first()["violations"]
        if strays:
            raise ValueError(f"{strays} scoring rows belong to another batch than {cfg.batch_id}")
    scoring = bounded_scoring_read(source, batch_id=cfg.batch_id, cutoff=cfg.scoring_cutoff)
    training = bounded_feature_read(sources.training, cutoff=cfg.cutoff)
    actuals = bounded_actuals_read(sources.actuals, cutoff=cfg.cutoff)
    for name, frame in (("scoring", scoring), ("training", training), ("actuals", actuals)):
        write_snapshot(frame, f"{run_dir}/pull/{name}")
    scoring = read_snapshot(spark, f"{run_dir}/pull/scoring", SCORING)
    training = read_snapshot(spark, f"{run_dir}/pull/training", TRAINING_FEATURES)
    actuals = read_snapshot(spark, f"{run_dir}/pull/actuals", ACTUALS)
    ev.append((1, "pull", "PULLED", None, scoring.count()))

    # 2. build_features: rule tables -> PASS/BLOCK (P2-P10, J1, J2). The label-leak rule
    # looks at the raw scoring source, before the typed projection could drop a label.
    from pitloom.operators.contracts import label_leak
    from pitloom.plans.quality_queries import data_rules

    leaked = label_leak(sources.scoring.columns)
    if leaked:
        ev.append((2, "build_features", "BLOCK", f"scoring:label_leak:{','.join(leaked)}", len(leaked)))
        return skip_rest(2, "data contract blocked training")

    labeled = label_actuals(actuals, cfg.contract)
    spine = asof_join(labeled, training, tolerance=cfg.tolerance)
    write_snapshot(spine, f"{run_dir}/spine")
    spine = spark.read.parquet(f"{run_dir}/spine")
    rules = data_rules(scoring, training, actuals, spine, cfg.contract)
    dec = decision(rules, mapping_version=cfg.contract.mapping_version).first()
    if dec["decision"] != "PASS":
        ev.append((2, "build_features", "BLOCK", dec["reason"], dec["violations"]))
        return skip_rest(2, "data contract blocked training")
    ev.append((2, "build_features", "PASS", None, spine.count()))

    # 3. train: M1 on the spine; candidate version over the snapshot digest.
    result = train_classifier(
        spine, features=["signal_a", "signal_b"], label="quantity_class", key=["correlation_id"],
        seed=cfg.seed, num_trees=cfg.num_trees, max_depth=cfg.max_depth,
    )
    metrics = result.metrics.first()
    from pitloom.functions.identity import candidate_material, candidate_version
    from pitloom.plans.quality_queries import SPINE_RUN

    material = candidate_material(
        snapshot_sha256=F.col("snapshot_sha256"), source_cutoff=cfg.cutoff, mapping_version=cfg.contract.mapping_version,
        random_seed=cfg.seed, **SPINE_RUN,
    )
    version = snapshot_digest(spine).select(candidate_version(material)).first()[0]
    ev.append((3, "train", "TRAINED", f"candidate {version}", int(metrics["validation_rows"])))

    # 4. register_select: gate the candidate against the champion.
    cand_metrics = spark.createDataFrame(
        [("candidate", 0, m, float(metrics[m])) for m in ("macro_f1", "log_loss", "accuracy")],
        "model_version string, segment int, metric string, value double",
    )
    champ = spark.createDataFrame([], "segment int, metric string, value double")
    champions = spark.createDataFrame(
        [] if cfg.champion_class is None else [(0, "champion", cfg.champion_mapping or cfg.contract.mapping_version)],
        "segment int, champion_version string, champion_mapping string",
    )
    if cfg.champion_class is not None and cfg.champion_measured:
        # Both are measured on the same rows: the candidate's hold-out.
        champ = _constant_metrics(result.holdout, cfg.champion_class).select(F.lit(0).alias("segment"), "metric", "value")
    cands = cand_metrics.select("model_version", "segment").distinct()
    # M4: every candidate is registered with its metrics and mapping before the gate.
    from pitloom.operators.registry import append_registry, registry_rows

    append_registry(
        registry_rows(
            cands.withColumn("mapping_version", F.lit(cfg.contract.mapping_version)),
            cand_metrics.withColumn("model_version", F.lit(version)),
            cfg.model_name,
            [r.name for r in cfg.rules],
        ).withColumn("model_version", F.lit(version)),
        f"{run_dir}/registry",
    )
    reasons = gate_reasons(cands, cand_metrics, champions, champ, cfg.rules)
    stated = cands.withColumn("mapping_version", F.lit(cfg.contract.mapping_version))
    outcome = selected_model(gate_outcome(stated, reasons, champions), champions).first()
    if outcome["outcome"] == "HALT":
        ev.append((4, "register_select", "HALTED", outcome["reasons"], 0))
        return skip_rest(4, "no model selected")
    ev.append((4, "register_select", "SELECTED", outcome["outcome"], int(outcome["n_reasons"])))

    # 5. invoke_batch: score the scoring snapshot with the selected model (M3) -> CSV.
    if outcome["outcome"] == "PROMOTE":
        scored = batch_score(result.model, scoring, features=["signal_a", "signal_b"])
    else:
        scored = constant_baseline(scoring, cfg.champion_class).select(
            F.col("entity_id"), F.col("feature_ts").cast("string").alias("prediction_ts"),
            "source_batch_id", "correlation_id", "prediction_class",
        )
    write_scorer_csv(scored, f"{run_dir}/predictions")
    predictions = read_scorer_csv(spark, f"{run_dir}/predictions")
    ev.append((5, "invoke_batch", "SCORED", None, predictions.count()))

    # 6. publish: reconcile (J4), provenance (P12), staged idempotent upsert.
    from pitloom.plans.quality_queries import RUN, provenance

    expected = normalise_keys(scoring, ["entity_id", "feature_ts", "source_batch_id", "correlation_id"])
    delivered = normalise_keys(predictions, ["entity_id", "prediction_ts", "source_batch_id", "correlation_id"])
    require_complete(reconcile(expected, delivered))
    run = dict(RUN, MODEL_NAME=cfg.model_name, MODEL_VERSION=version if outcome["outcome"] == "PROMOTE" else outcome["selected_version"])
    frame = provenance(predictions, run, run_ts=cfg.run_ts, mapping_version=cfg.contract.mapping_version)
    # Their ids hash seven fields, and a publication reads the rows several times.
    write_snapshot(frame, f"{run_dir}/provenance")
    frame = spark.read.schema(frame.schema).parquet(f"{run_dir}/provenance")
    target = cfg.table or f"{run_dir}/published"
    for _ in range(1 + cfg.replays):
        publish(frame, target)
    visible = read_predictions(spark, target).where(F.col("source_batch_id") == cfg.batch_id).count()
    ev.append((6, "publish", "PUBLISHED", None, visible))

    # 7. prepare_monitor_data: the four monitor tables.
    tables = monitor_tables(
        scoring, predictions, spine.where(F.col("feature_ts").isNotNull()), labeled.where(F.col("quantity_class").isNotNull())
    )
    manifest = write_monitor_tables(tables, f"{run_dir}/monitor", published=True)
    ev.append((7, "prepare_monitor_data", manifest["status"], None, int(manifest["model_outputs_rows"])))
    return _evidence(spark, ev)


def _constant_metrics(spine: DataFrame, cls: str) -> DataFrame:
    """Metrics of the constant-class champion on the same labels (M2)."""
    from pitloom.operators.metrics import confusion, log_loss

    scored = constant_baseline(spine.where(F.col("feature_ts").isNotNull()), cls).select(
        "prediction_class", "quantity_class", F.when(F.col("quantity_class") == cls, 1.0).otherwise(0.0).alias("p")
    )
    conf = confusion(scored, "prediction_class", "quantity_class")
    f1 = conf.agg(F.avg("f1").alias("value")).select(F.lit("macro_f1").alias("metric"), "value")
    ll = scored.agg(log_loss(F.col("p")).alias("value")).select(F.lit("log_loss").alias("metric"), "value")
    return f1.unionByName(ll)


def fixture_sources(spark: SparkSession, sf_dir: str, actuals: str = "fx_actuals") -> Populations:
    return Populations(
        scoring=fixture(spark, sf_dir, "fx_scoring"),
        training=fixture(spark, sf_dir, "fx_features"),
        actuals=fixture(spark, sf_dir, actuals),
    )


# ---------------------------------------------------------------- registered queries
from pitloom.plans.quality_queries import _decision_sql  # noqa: E402
from pitloom.plans.registry import (  # noqa: E402
    CUTOFF,
    NARROW_CONTRACT,
    SCORING_BATCH,
    SCORING_CUTOFF,
    register,
)


@register("l1_lifecycle")
def l1_lifecycle(spark, sf_dir):
    """End to end with the reference's settings (30-day tolerance, quantity domain 0-20) on
    order-level actuals, which pass the data contract; a constant class-"1" model is the
    champion. Rows-only check (model metrics decide the gate)."""
    cfg = LifecycleConfig(
        batch_id=SCORING_BATCH, cutoff=CUTOFF, scoring_cutoff=SCORING_CUTOFF, champion_class="1", replays=1
    )
    return run_lifecycle(spark, fixture_sources(spark, sf_dir, "fx_order_actuals"), cfg)


@register(
    "l2_stage_evidence",
    f"""
SELECT 1 AS stage_no, 'pull' AS stage, 'PULLED' AS status, CAST(NULL AS VARCHAR) AS reason,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM fx_scoring WHERE source_batch_id = '{SCORING_BATCH}' AND feature_ts <= TIMESTAMP '{SCORING_CUTOFF}') AS rows
UNION ALL SELECT 2, 'build_features', d.decision, d.reason, d.violations FROM ({_decision_sql('x', 20)}) d
UNION ALL SELECT 3, 'train', 'SKIPPED', 'data contract blocked training', 0
UNION ALL SELECT 4, 'register_select', 'SKIPPED', 'data contract blocked training', 0
UNION ALL SELECT 5, 'invoke_batch', 'SKIPPED', 'data contract blocked training', 0
UNION ALL SELECT 6, 'publish', 'SKIPPED', 'data contract blocked training', 0
UNION ALL SELECT 7, 'prepare_monitor_data', 'SKIPPED', 'data contract blocked training', 0""",
)
def l2_stage_evidence(spark, sf_dir):
    """The reference's own settings (30-day tolerance, quantity domain 0-20) block at
    build_features; every later stage records SKIPPED."""
    cfg = LifecycleConfig(
        batch_id=SCORING_BATCH, cutoff=CUTOFF, scoring_cutoff=SCORING_CUTOFF, contract=NARROW_CONTRACT
    )
    return run_lifecycle(spark, fixture_sources(spark, sf_dir), cfg)
