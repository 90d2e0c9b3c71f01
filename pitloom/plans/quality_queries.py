"""Registered queries: contract checks, identities and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.functions.identity import (
    JsonText,
    candidate_material,
    candidate_version,
    is_blank,
    iso_utc,
    kinds,
    prediction_id,
    retraining_job_name,
    row_hash,
    utc_ntz,
    version_slug,
)
from pitloom.functions.quantity import QUANTITY_RULES, QuantityContract
from pitloom.operators import contracts as C
from pitloom.operators.asof import asof_coverage, asof_join
from pitloom.operators.digest import snapshot_digest
from pitloom.plans import sqltext as Q
from pitloom.plans.join_queries import training_spine
from pitloom.plans.registry import (
    CONTRACT,
    CUTOFF,
    MAPPING_VERSION,
    MODEL_NAME,
    NARROW_CONTRACT,
    RUN_TS,
    SCORING_BATCH,
    SCORING_CUTOFF,
    TOLERANCE,
    fx,
    register,
)
from pitloom.session import ensure_checkpoint_dir, scratch_path
from pitloom.sources.snapshot import (
    batch_membership,
    bounded_actuals_read,
    bounded_feature_read,
    bounded_scoring_read,
    read_scorer_csv,
    read_scoring_input,
    read_snapshot,
    write_scorer_csv,
    write_snapshot,
    write_sorted_snapshot,
)
from pitloom.schemas import ACTUALS, SCORING, TRAINING_FEATURES

# ---------------------------------------------------------------- fault injection
# Nulls, NaN, blanks and fractions do not occur in the test tables; these projections
# put them in at fixed residues of an id, identically in Spark and in the oracle.
INJECT_KEYS = """
SELECT CASE WHEN CAST(entity_id AS BIGINT) % 37 = 0 THEN NULL ELSE entity_id END AS entity_id,
       CASE WHEN CAST(entity_id AS BIGINT) % 41 = 0 THEN NULL ELSE feature_ts END AS feature_ts,
       signal_a, signal_b
FROM {src}"""

INJECT_FEATURES = """
SELECT entity_id, feature_ts,
       CASE WHEN CAST(entity_id AS BIGINT) % 43 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN CAST(entity_id AS BIGINT) % 47 = 0 THEN NULL ELSE signal_a END AS signal_a,
       CASE WHEN CAST(entity_id AS BIGINT) % 53 = 0 THEN NULL ELSE signal_b END AS signal_b
FROM {src}"""

INJECT_CORRELATION = """
SELECT entity_id, feature_ts, signal_a, signal_b, source_batch_id,
       CASE WHEN CAST(correlation_id AS BIGINT) % 59 = 0 THEN NULL
            WHEN CAST(correlation_id AS BIGINT) % 61 = 0 THEN ' '
            WHEN CAST(correlation_id AS BIGINT) % 67 = 0 THEN chr(9)
            WHEN CAST(correlation_id AS BIGINT) % 71 = 0 THEN 'dup'
            ELSE correlation_id END AS correlation_id
FROM {src}"""

INJECT_QUANTITY = """
SELECT entity_id, event_ts, label_available_ts, correlation_id,
       CASE WHEN CAST(split_part(correlation_id, '-', 1) AS BIGINT) % 31 = 0 THEN NULL
            WHEN CAST(split_part(correlation_id, '-', 1) AS BIGINT) % 37 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN CAST(split_part(correlation_id, '-', 1) AS BIGINT) % 41 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN CAST(split_part(correlation_id, '-', 1) AS BIGINT) % 43 = 0 THEN actual_quantity + 0.5
            WHEN CAST(split_part(correlation_id, '-', 1) AS BIGINT) % 47 = 0 THEN -actual_quantity
            ELSE actual_quantity END AS actual_quantity
FROM {src}"""


def _inject(spark, text, src):
    return spark.sql(text, src=src)


def _duck_inject(text, src):
    return "(" + text.replace("{src}", src) + ")"


def _rules_sql(population: str, first: int, rules: list[tuple[str, str]], source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{population}' AS population, '{name}' AS rule, {first + i} AS ordinal, "
        f"CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM {source}"
        for i, (name, cond) in enumerate(rules)
    )


def _dup_sql(population: str, rule: str, ordinal: int, source: str, keys: list[str]) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    k = ", ".join(keys)
    return (
        f"SELECT '{population}' AS population, '{rule}' AS rule, {ordinal} AS ordinal, "
        f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations FROM "
        f"(SELECT COUNT(*) AS n FROM {source} WHERE {present} GROUP BY {k} HAVING COUNT(*) > 1) d"
    )


# ---------------------------------------------------------------- P3 .. P8
@register(
    "p3_null_keys",
    _rules_sql(
        "training_features", 1,
        [("null_entity_id", "entity_id IS NULL"), ("null_feature_ts", "feature_ts IS NULL")],
        _duck_inject(INJECT_KEYS, "fx_features") + " k",
    ),
)
def p3_null_keys(spark, sf_dir):
    frame = _inject(spark, INJECT_KEYS, fx(spark, sf_dir, "fx_features"))
    return C.rule_table(frame, "training_features", C.null_key_rules(["entity_id", "feature_ts"]), 1)


@register(
    "p4_null_features",
    _rules_sql(
        "training_features", 1,
        [("null_signal_a", "signal_a IS NULL OR isnan(signal_a)"), ("null_signal_b", "signal_b IS NULL OR isnan(signal_b)")],
        _duck_inject(INJECT_FEATURES, "fx_features") + " f",
    ),
)
def p4_null_features(spark, sf_dir):
    frame = _inject(spark, INJECT_FEATURES, fx(spark, sf_dir, "fx_features"))
    return C.rule_table(frame, "training_features", C.null_feature_rules(["signal_a", "signal_b"]), 1)


@register(
    "p5_correlation_ids",
    _rules_sql(
        "scoring", 1,
        [("blank_correlation_id", "correlation_id IS NULL OR regexp_matches(correlation_id, '^\\s*$')")],
        _duck_inject(INJECT_CORRELATION, "fx_scoring") + " c",
    )
    + "\nUNION ALL\n"
    + _dup_sql("scoring", "duplicate_correlation_id", 2, _duck_inject(INJECT_CORRELATION, "fx_scoring") + " c", ["correlation_id"]),
)
def p5_correlation_ids(spark, sf_dir):
    frame = _inject(spark, INJECT_CORRELATION, fx(spark, sf_dir, "fx_scoring"))
    return C.correlation_rules(frame, "correlation_id", "scoring", 1)


@register(
    "p6_duplicate_grain",
    """
SELECT entity_id, feature_ts, CAST(COUNT(*) AS BIGINT) AS rows FROM fx_features_raw
GROUP BY entity_id, feature_ts HAVING COUNT(*) > 1""",
)
def p6_duplicate_grain(spark, sf_dir):
    return C.duplicate_grain(fx(spark, sf_dir, "fx_features_raw"), ["entity_id", "feature_ts"])


_Q_FINITE = "NOT isnan(actual_quantity) AND NOT isinf(actual_quantity)"


@register(
    "p8_quantity_violations",
    _rules_sql(
        "actuals", 1,
        [
            ("quantity_missing", "actual_quantity IS NULL"),
            ("quantity_non_finite", "isnan(actual_quantity) OR isinf(actual_quantity)"),
            ("quantity_not_integral", f"{_Q_FINITE} AND actual_quantity % 1 <> 0"),
            (
                "quantity_out_of_domain",
                f"{_Q_FINITE} AND actual_quantity % 1 = 0 AND NOT (actual_quantity BETWEEN 0 AND 20)",
            ),
        ],
        _duck_inject(INJECT_QUANTITY, "fx_actuals") + " q",
    ),
)
def p8_quantity_violations(spark, sf_dir):
    frame = _inject(spark, INJECT_QUANTITY, fx(spark, sf_dir, "fx_actuals"))
    return C.quantity_rules(frame, NARROW_CONTRACT, "actual_quantity", "actuals", 1)


# ---------------------------------------------------------------- P9 mapping versions
_ARTIFACT_MAPPING = (
    "CASE WHEN segment = 3 THEN 'quantity-v2' WHEN segment = 4 THEN NULL ELSE 'quantity-v1' END"
)


def candidate_artifacts(spark, sf_dir):
    """Registered candidates with the mapping version they were trained with."""
    m = fx(spark, sf_dir, "fx_candidate_metrics").select("model_version", "segment").distinct()
    return m.withColumn("mapping_version", F.expr(_ARTIFACT_MAPPING))


@register(
    "p9_mapping_mismatch",
    f"""
SELECT model_version AS artifact, {_ARTIFACT_MAPPING} AS observed, '{MAPPING_VERSION}' AS expected
FROM (SELECT DISTINCT model_version, segment FROM fx_candidate_metrics) m
WHERE {_ARTIFACT_MAPPING} IS DISTINCT FROM '{MAPPING_VERSION}'""",
)
def p9_mapping_mismatch(spark, sf_dir):
    art = candidate_artifacts(spark, sf_dir)
    return art.where(CONTRACT.mapping_mismatch(F.col("mapping_version"))).select(
        F.col("model_version").alias("artifact"),
        F.col("mapping_version").alias("observed"),
        F.lit(MAPPING_VERSION).alias("expected"),
    )


# ---------------------------------------------------------------- P10 decision
def data_rules(scoring, training, actuals, spine, contract: QuantityContract):
    """Every rule of the build-features stage, with the reference's order of checks as
    ordinals. Row rules of one population share one aggregate pass; uniqueness rules
    are one grouped pass each."""
    keys = ["entity_id", "feature_ts"]
    feats = ["signal_a", "signal_b"]
    empty = C.EMPTY
    frame_rules = C.null_key_rules(keys) + C.null_feature_rules(feats)
    scoring_rules = [(empty, None), ("blank_correlation_id", is_blank(F.col("correlation_id")))] + frame_rules
    contract.check_type(actuals, "actual_quantity")
    q = contract.violation(F.col("actual_quantity"))
    quantity = [(r, q == F.lit(r)) for r in QUANTITY_RULES]
    ordinals = {
        ("scoring", empty): 1, ("training_features", empty): 2, ("actuals", empty): 3,
        ("scoring", "blank_correlation_id"): 4,
        # Null keys, then the grain (8 and 13, below), then null features.
        **{("scoring", n): o for o, (n, _) in zip((6, 7, 9, 10), frame_rules, strict=True)},
        **{("training_features", n): o for o, (n, _) in zip((11, 12, 14, 15), frame_rules, strict=True)},
        **{("actuals", n): 16 + i for i, (n, _) in enumerate(quantity)},
    }

    def table(frame, population, rules):
        t = C.rule_table(frame, population, rules, 0)
        mapping = F.create_map(*[x for (p, n), o in ordinals.items() if p == population for x in (F.lit(n), F.lit(o))])
        return t.withColumn("ordinal", mapping[F.col("rule")])

    return (
        table(scoring, "scoring", scoring_rules)
        .unionByName(table(training, "training_features", [(empty, None)] + frame_rules))
        .unionByName(table(actuals, "actuals", [(empty, None)] + quantity))
        .unionByName(C.duplicate_keys(scoring, ["correlation_id"], "scoring", "duplicate_correlation_id", 5))
        .unionByName(C.duplicate_keys(scoring, keys, "scoring", "duplicate_grain", 8))
        .unionByName(C.duplicate_keys(training, keys, "training_features", "duplicate_grain", 13))
        .unionByName(
            asof_coverage(spine).select(
                F.lit("spine").alias("population"),
                F.lit("unmatched_label").alias("rule"),
                F.lit(20).alias("ordinal"),
                F.col("unmatched").alias("violations"),
            )
        )
    )


def data_decisions(spark, sf_dir, contracts: dict[str, QuantityContract]):
    """P10 for several quantity contracts over the same bounded inputs; the as-of spine
    (coverage does not depend on the class mapping) is built once."""
    # The pulled populations and the spine feed every rule branch: materialise them once in
    # the shared checkpoint folder (as the lifecycle does after its pull).
    ensure_checkpoint_dir(spark)
    scoring = bounded_scoring_read(
        fx(spark, sf_dir, "fx_scoring"), batch_id=SCORING_BATCH, cutoff=SCORING_CUTOFF
    ).checkpoint(eager=True)
    training = bounded_feature_read(fx(spark, sf_dir, "fx_features"), cutoff=CUTOFF).checkpoint(eager=True)
    actuals = bounded_actuals_read(fx(spark, sf_dir, "fx_actuals"), cutoff=CUTOFF).checkpoint(eager=True)
    spine = asof_join(actuals, training, tolerance=TOLERANCE).checkpoint(eager=True)
    counts = scoring.agg(F.count(F.lit(1)).alias("feature_rows")).unionByName(
        spine.agg(F.count(F.lit(1)).alias("training_rows")), allowMissingColumns=True
    )
    out = None
    for scenario, contract in contracts.items():
        rules = data_rules(scoring, training, actuals, spine, contract)
        d = C.decision(rules, mapping_version=contract.mapping_version, counts=counts)
        d = d.select(F.lit(scenario).alias("scenario"), "*")
        out = d if out is None else out.unionByName(d)
    return out


def _decision_sql(scenario: str, maximum: int) -> str:
    sc = f"(SELECT * FROM fx_scoring WHERE source_batch_id = '{SCORING_BATCH}' AND feature_ts <= TIMESTAMP '{SCORING_CUTOFF}') sc"
    tr = f"(SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') tr"
    ac = f"(SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}') ac"
    spine = f"""(SELECT a.*, CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.feature_ts END AS f_ts
       FROM {ac.replace(') ac', ') a')} ASOF LEFT JOIN {tr.replace(') tr', ') f')}
       ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts) sp"""
    null_rules = [
        ("null_entity_id", "entity_id IS NULL"),
        ("null_feature_ts", "feature_ts IS NULL"),
        ("null_signal_a", "signal_a IS NULL OR isnan(signal_a)"),
        ("null_signal_b", "signal_b IS NULL OR isnan(signal_b)"),
    ]
    q = "actual_quantity"
    parts = [
        f"SELECT 'scoring' AS population, 'empty' AS rule, 1 AS ordinal, CAST(CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM {sc}",
        f"SELECT 'training_features', 'empty', 2, CAST(CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM {tr}",
        f"SELECT 'actuals', 'empty', 3, CAST(CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM {ac}",
        _rules_sql("scoring", 4, [("blank_correlation_id", "correlation_id IS NULL OR regexp_matches(correlation_id, '^\\s*$')")], sc),
        _dup_sql("scoring", "duplicate_correlation_id", 5, sc, ["correlation_id"]),
        _rules_sql("scoring", 6, null_rules[:2], sc),
        _dup_sql("scoring", "duplicate_grain", 8, sc, ["entity_id", "feature_ts"]),
        _rules_sql("scoring", 9, null_rules[2:], sc),
        _rules_sql("training_features", 11, null_rules[:2], tr),
        _dup_sql("training_features", "duplicate_grain", 13, tr, ["entity_id", "feature_ts"]),
        _rules_sql("training_features", 14, null_rules[2:], tr),
        _rules_sql(
            "actuals", 16,
            [
                ("quantity_missing", f"{q} IS NULL"),
                ("quantity_non_finite", f"isnan({q}) OR isinf({q})"),
                ("quantity_not_integral", f"{_Q_FINITE} AND {q} % 1 <> 0"),
                ("quantity_out_of_domain", f"{_Q_FINITE} AND {q} % 1 = 0 AND NOT ({q} BETWEEN 0 AND {maximum})"),
            ],
            ac,
        ),
        f"SELECT 'spine', 'unmatched_label', 20, CAST(COUNT(*) FILTER (WHERE f_ts IS NULL) AS BIGINT) FROM {spine}",
    ]
    rules = "\nUNION ALL\n".join(parts)
    return f"""
SELECT '{scenario}' AS scenario,
       CASE WHEN f.ordinal IS NULL THEN 'PASS' ELSE 'BLOCK' END AS decision,
       CASE WHEN f.ordinal IS NULL THEN NULL ELSE f.population || ':' || f.rule END AS reason,
       CAST(COALESCE(f.violations, 0) AS BIGINT) AS violations,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM ({rules}) r WHERE violations > 0) AS failing_rules,
       '{MAPPING_VERSION}' AS mapping_version,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM {sc}) AS feature_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM {spine}) AS training_rows
FROM (SELECT 1) one LEFT JOIN (
  SELECT * FROM ({rules}) r WHERE violations > 0 ORDER BY ordinal LIMIT 1
) f ON TRUE"""


@register(
    "p10_data_decision",
    _decision_sql("domain_0_20", 20) + "\nUNION ALL\n" + _decision_sql("domain_0_50", 50),
)
def p10_data_decision(spark, sf_dir):
    return data_decisions(spark, sf_dir, {"domain_0_20": NARROW_CONTRACT, "domain_0_50": CONTRACT})


# ---------------------------------------------------------------- P11 / P12 / F2 / A14
RUN = {
    "AML_PIPELINE_JOB_ID": "local",
    "MLFLOW_RUN_ID": "run-local",
    "FEATURE_SET_NAME": "quantity_features",
    "FEATURE_SET_VERSION": "1",
    "MODEL_NAME": MODEL_NAME,
    "MODEL_VERSION": "7",
    "BATCH_ENDPOINT_NAME": "quantity-batch",
}


def provenance(predictions, run=RUN, *, run_ts: str = RUN_TS, mapping_version: str = MAPPING_VERSION):
    """The 19-column publication frame; ``ACTUAL_*`` null, both stamps = the run time."""
    ts = utc_ntz(F.col("prediction_ts"), predictions.schema["prediction_ts"].dataType)
    pid = prediction_id(
        source_batch_id=F.col("source_batch_id").cast("string"),
        entity_id=F.col("entity_id").cast("string"),
        correlation_id=F.col("correlation_id").cast("string"),
        prediction_ts=iso_utc(ts),
        model_name=F.lit(run["MODEL_NAME"]),
        model_version=F.lit(run["MODEL_VERSION"]),
        mapping_version=F.lit(mapping_version),
    )
    stamp = F.lit(run_ts).cast("timestamp_ntz")
    return predictions.select(
        pid.alias("PREDICTION_ID"),
        F.col("source_batch_id").cast("string").alias("SOURCE_BATCH_ID"),
        F.col("entity_id").cast("string").alias("ENTITY_ID"),
        F.col("correlation_id").cast("string").alias("CORRELATION_ID"),
        ts.alias("PREDICTION_TS"),
        *[F.lit(run[c]).alias(c) for c in ("AML_PIPELINE_JOB_ID", "MLFLOW_RUN_ID", "FEATURE_SET_NAME", "FEATURE_SET_VERSION", "MODEL_NAME", "MODEL_VERSION", "BATCH_ENDPOINT_NAME")],
        version_slug(F.lit(run["MODEL_VERSION"])).alias("BATCH_DEPLOYMENT_NAME"),
        F.lit(mapping_version).alias("QUANTITY_CLASS_MAPPING_VERSION"),
        F.col("prediction_class").cast("string").alias("PREDICTION_CLASS"),
        F.lit(None).cast("double").alias("ACTUAL_QUANTITY"),
        F.lit(None).cast("string").alias("ACTUAL_CLASS"),
        stamp.alias("CREATED_AT"),
        stamp.alias("UPDATED_AT"),
    )


_PID_SQL = Q.prediction_id(
    {
        "entity_id": "entity_id",
        "correlation_id": "correlation_id",
        "mapping_version": Q.lit(MAPPING_VERSION),
        "model_name": Q.lit(RUN["MODEL_NAME"]),
        "model_version": Q.lit(RUN["MODEL_VERSION"]),
        "prediction_ts": Q.iso("prediction_ts"),
        "source_batch_id": "source_batch_id",
    }
)

PROVENANCE_SQL = f"""
SELECT {_PID_SQL} AS PREDICTION_ID, source_batch_id AS SOURCE_BATCH_ID, entity_id AS ENTITY_ID,
       correlation_id AS CORRELATION_ID, prediction_ts AS PREDICTION_TS,
       {', '.join(f"{Q.lit(RUN[c])} AS {c}" for c in ("AML_PIPELINE_JOB_ID", "MLFLOW_RUN_ID", "FEATURE_SET_NAME", "FEATURE_SET_VERSION", "MODEL_NAME", "MODEL_VERSION", "BATCH_ENDPOINT_NAME"))},
       'v-7' AS BATCH_DEPLOYMENT_NAME, '{MAPPING_VERSION}' AS QUANTITY_CLASS_MAPPING_VERSION,
       prediction_class AS PREDICTION_CLASS, CAST(NULL AS DOUBLE) AS ACTUAL_QUANTITY,
       CAST(NULL AS VARCHAR) AS ACTUAL_CLASS,
       TIMESTAMP '{RUN_TS}' AS CREATED_AT, TIMESTAMP '{RUN_TS}' AS UPDATED_AT
FROM fx_predictions"""


@register("p12_provenance", PROVENANCE_SQL)
def p12_provenance(spark, sf_dir):
    return provenance(fx(spark, sf_dir, "fx_predictions"))


@register(
    "p11_prediction_contract",
    "WITH pf AS (" + PROVENANCE_SQL + ")\n"
    + _rules_sql(
        "predictions", 1,
        [(f"null_{c.lower()}", f"{c} IS NULL") for c in C.PREDICTION_COLUMNS if c not in ("ACTUAL_QUANTITY", "ACTUAL_CLASS")],
        "pf",
    )
    + "\nUNION ALL\n"
    + _dup_sql("predictions", "duplicate_prediction_id", 18, "pf", ["PREDICTION_ID"]),
)
def p11_prediction_contract(spark, sf_dir):
    return C.prediction_contract_rules(provenance(fx(spark, sf_dir, "fx_predictions")))


@register(
    "f2_prediction_id",
    f"SELECT entity_id, correlation_id, source_batch_id, {_PID_SQL} AS prediction_id FROM fx_predictions",
)
def f2_prediction_id(spark, sf_dir):
    p = fx(spark, sf_dir, "fx_predictions")
    return provenance(p).select(
        F.col("ENTITY_ID").alias("entity_id"),
        F.col("CORRELATION_ID").alias("correlation_id"),
        F.col("SOURCE_BATCH_ID").alias("source_batch_id"),
        F.col("PREDICTION_ID").alias("prediction_id"),
    )


# Ids with characters beyond ASCII, beyond 16 bits, and ones that JSON escapes.
_ODD_ID = "'\u00e9\u6f22\U0001f9d1\"\\' || correlation_id || chr(10) || chr(127)"


@register(
    "f2_prediction_id_any_text",
    f"""
SELECT entity_id, source_batch_id, odd_id AS correlation_id, {Q.prediction_id({
    "source_batch_id": "source_batch_id", "entity_id": "entity_id", "correlation_id": "odd_id", "prediction_ts": Q.iso("prediction_ts"),
    "model_name": Q.lit(MODEL_NAME), "model_version": "'3'", "mapping_version": Q.lit(MAPPING_VERSION)}, escaped=True)} AS prediction_id
FROM (SELECT *, {_ODD_ID} AS odd_id FROM fx_predictions) p""",
)
def f2_prediction_id_any_text(spark, sf_dir):
    """F2 over ids of any characters: the JSON text of Python's ``json.dumps``, in every engine."""
    odd = F.concat(F.lit('\u00e9\u6f22\U0001f9d1"\\'), F.col("correlation_id"), F.lit("\n\x7f"))
    p = fx(spark, sf_dir, "fx_predictions").withColumn("correlation_id", odd)
    found = prediction_id(
        source_batch_id=F.col("source_batch_id"), entity_id=F.col("entity_id"), correlation_id=F.col("correlation_id"),
        prediction_ts=iso_utc(F.col("prediction_ts")), model_name=F.lit(MODEL_NAME), model_version=F.lit("3"), mapping_version=F.lit(MAPPING_VERSION),
    )
    return p.select("entity_id", "source_batch_id", "correlation_id", found.alias("prediction_id"))


@register(
    "a14_publication_check",
    f"""
SELECT SOURCE_BATCH_ID, MODEL_NAME, MODEL_VERSION, QUANTITY_CLASS_MAPPING_VERSION,
       CAST(COUNT(*) AS BIGINT) AS ROWS, CAST(COUNT(DISTINCT PREDICTION_ID) AS BIGINT) AS UNIQUE_PREDICTIONS,
       CAST(COUNT(DISTINCT CORRELATION_ID) AS BIGINT) AS UNIQUE_BUSINESS_EVENTS
FROM ({PROVENANCE_SQL}) p GROUP BY 1, 2, 3, 4""",
)
def a14_publication_check(spark, sf_dir):
    p = provenance(fx(spark, sf_dir, "fx_predictions"))
    return p.groupBy("SOURCE_BATCH_ID", "MODEL_NAME", "MODEL_VERSION", "QUANTITY_CLASS_MAPPING_VERSION").agg(
        F.count(F.lit(1)).alias("ROWS"),
        F.count_distinct("PREDICTION_ID").alias("UNIQUE_PREDICTIONS"),
        F.count_distinct("CORRELATION_ID").alias("UNIQUE_BUSINESS_EVENTS"),
    )


# ---------------------------------------------------------------- F4 F5 F6 F7 F9
@register(
    "f4_retrain_job_name",
    f"SELECT event_id, 'retrain-' || substr(sha256({Q.json_object({'event_grid_event_id': 'event_id'})}), 1, 24) AS job_name FROM fx_run_events",
)
def f4_retrain_job_name(spark, sf_dir):
    e = fx(spark, sf_dir, "fx_run_events")
    return e.select("event_id", retraining_job_name(F.col("event_id")).alias("job_name"))


_FEATURE_KINDS = [
    ("entity_id", "text"), ("feature_ts", "timestamp"), ("signal_a", "double"), ("signal_b", "double"), ("signal_c", "double"),
]
# A signal whose values lie below 1e-3 and differ below 1e-6: only an exact text of doubles tells them apart.
SMALL = 1e-9


@register(
    "f5_feature_rows",
    f"""
SELECT entity_id, feature_ts, signal_a, signal_b, signal_c, {Q.row_hash(_FEATURE_KINDS)} AS feature_row_hash
FROM (SELECT *, -(signal_a * {SMALL!r}::DOUBLE) AS signal_c FROM fx_features) f""",
)
def f5_feature_rows(spark, sf_dir):
    """predictor-only snapshot with a hash of each row's exact values."""
    f = fx(spark, sf_dir, "fx_features").withColumn("signal_c", -(F.col("signal_a") * SMALL))
    return f.withColumn("feature_row_hash", row_hash(kinds(f.schema)))


@register(
    "f6_iso_timestamp",
    f"SELECT event_id, event_ts, {Q.iso('event_ts')} AS event_time FROM fx_run_events",
)
def f6_iso_timestamp(spark, sf_dir):
    e = fx(spark, sf_dir, "fx_run_events")
    return e.select("event_id", "event_ts", iso_utc(F.col("event_ts")).alias("event_time"))


@register(
    "f7_blank_and_case",
    """
SELECT e.event_id, (e.breach_tag IS NULL OR regexp_matches(e.breach_tag, '^\\s*$')) AS breach_blank,
       lower(e.event_type) AS event_type_folded, lower(s.status) = 'failed' AS status_failed
FROM fx_run_events e LEFT JOIN fx_job_status s ON e.run_id = s.run_id""",
)
def f7_blank_and_case(spark, sf_dir):
    e = fx(spark, sf_dir, "fx_run_events")
    s = fx(spark, sf_dir, "fx_job_status")
    return e.join(s, "run_id", "left").select(
        "event_id",
        is_blank(F.col("breach_tag")).alias("breach_blank"),
        F.lower("event_type").alias("event_type_folded"),
        (F.lower("status") == "failed").alias("status_failed"),
    )


@register(
    "f9_version_slug",
    """
SELECT model_version, substr(regexp_replace(regexp_replace(lower('v-' || model_version), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32) AS deployment_name
FROM (SELECT DISTINCT model_version FROM fx_candidate_metrics) m""",
)
def f9_version_slug(spark, sf_dir):
    m = fx(spark, sf_dir, "fx_candidate_metrics").select("model_version").distinct()
    return m.select("model_version", version_slug(F.col("model_version")).alias("deployment_name"))


# ---------------------------------------------------------------- A15 / F3
_SPINE_KINDS = [
    ("entity_id", "text"), ("event_ts", "timestamp"), ("label_available_ts", "timestamp"),
    ("actual_quantity", "double"), ("correlation_id", "text"), ("quantity_class", "text"),
    ("quantity_class_mapping_version", "text"), ("feature_ts", "timestamp"), ("signal_a", "double"),
    ("signal_b", "double"), ("signal_c", "double"),
]
_SPINE_SCHEMA = (
    "entity_id:string,event_ts:timestamp_ntz,label_available_ts:timestamp_ntz,actual_quantity:double,"
    "correlation_id:string,quantity_class:string,quantity_class_mapping_version:string,"
    "feature_ts:timestamp_ntz,signal_a:double,signal_b:double,signal_c:double"
)
_SPINE_SQL = f"""(SELECT *, signal_a * {SMALL!r}::DOUBLE AS signal_c FROM (SELECT a.entity_id, a.event_ts, a.label_available_ts, a.actual_quantity, a.correlation_id,
       CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class, '{MAPPING_VERSION}' AS quantity_class_mapping_version,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.feature_ts END AS feature_ts,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.signal_a END AS signal_a,
       CASE WHEN f.feature_ts >= a.event_ts - INTERVAL 30 DAY THEN f.signal_b END AS signal_b
FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}') a
ASOF LEFT JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') f
  ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts) joined) spine"""


def _digest_spine(spark, sf_dir):
    return training_spine(spark, sf_dir).withColumn("signal_c", F.col("signal_a") * SMALL)


@register("a15_snapshot_digest", Q.digest_select(_SPINE_SQL, _SPINE_KINDS, _SPINE_SCHEMA))
def a15_snapshot_digest(spark, sf_dir):
    return snapshot_digest(_digest_spine(spark, sf_dir))


# Canonical texts of the three bounded reads (hashed into manifests and versions).
SCORING_QUERY = (
    "SELECT entity_id, feature_ts, signal_a, signal_b, correlation_id, source_batch_id FROM scoring_source "
    "WHERE source_batch_id = :source_batch_id AND feature_ts <= :source_cutoff"
)
FEATURES_QUERY = (
    "SELECT entity_id, feature_ts, signal_a, signal_b FROM training_feature_source WHERE feature_ts <= :source_cutoff"
)
ACTUALS_QUERY = (
    "SELECT entity_id, event_ts, label_available_ts, actual_quantity, correlation_id FROM delayed_actuals "
    "WHERE label_available_ts <= :source_cutoff"
)
MODEL_IMPLEMENTATION = "spark-random-forest-1"
RANDOM_SEED = 17
#: What all runs over the training spine share.
SPINE_RUN = {
    "model_implementation": MODEL_IMPLEMENTATION,
    "training_features_query": FEATURES_QUERY,
    "actuals_query": ACTUALS_QUERY,
    "entity_column": "entity_id",
    "feature_timestamp_column": "feature_ts",
    "correlation_column": "correlation_id",
    "feature_columns": ["signal_a", "signal_b"],
}


#: Runs of one snapshot that differ in one input each: (variant, seed, cutoff, mapping).
F3_RUNS = (
    ("base", RANDOM_SEED, CUTOFF, MAPPING_VERSION),
    ("seed", RANDOM_SEED + 1, CUTOFF, MAPPING_VERSION),
    ("cutoff", RANDOM_SEED, "2000-06-30 00:00:01", MAPPING_VERSION),
    ("mapping", RANDOM_SEED, CUTOFF, "quantity-v2"),
)


def _f3_sql() -> str:
    import hashlib

    runs = ", ".join(f"({Q.lit(v)}, {seed}, {Q.lit(c)}, {Q.lit(m)})" for v, seed, c, m in F3_RUNS)
    head = (
        f"'{{\"actuals_query_sha256\":\"{hashlib.sha256(ACTUALS_QUERY.encode()).hexdigest()}\",\"correlation_column\":\"correlation_id\","
        "\"entity_column\":\"entity_id\",\"feature_columns\":[\"signal_a\",\"signal_b\"],\"feature_timestamp_column\":\"feature_ts\",\"mapping_version\":\"'"
    )
    js = (
        f"{head} || mapping_version || '\",\"model_implementation\":\"{MODEL_IMPLEMENTATION}\",\"random_seed\":' || random_seed || "
        "',\"snapshot_sha256\":\"' || d.snapshot_sha256 || '\",\"source_cutoff\":\"' || source_cutoff || "
        f"'\",\"training_features_query_sha256\":\"{hashlib.sha256(FEATURES_QUERY.encode()).hexdigest()}\"}}'"
    )
    return f"""
SELECT variant, substr(sha256({js}), 1, 16) AS candidate_version, d.snapshot_sha256
FROM ({Q.digest_select(_SPINE_SQL, _SPINE_KINDS, _SPINE_SCHEMA)}) d,
     (VALUES {runs}) AS r(variant, random_seed, source_cutoff, mapping_version)"""


@register("f3_candidate_version", _f3_sql())
def f3_candidate_version(spark, sf_dir):
    """The version of the run's snapshot under the run's own seed, cutoff and mapping, and under others."""
    runs = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.lit(seed).alias("seed"), F.lit(c).alias("cutoff"), F.lit(m).alias("mapping"))
            for v, seed, c, m in F3_RUNS
        ]
    )
    d = snapshot_digest(_digest_spine(spark, sf_dir)).select("snapshot_sha256", F.inline(runs))
    version = candidate_version(
        candidate_material(
            snapshot_sha256=F.col("snapshot_sha256"), source_cutoff=F.col("cutoff"), mapping_version=F.col("mapping"),
            random_seed=JsonText(F.col("seed").cast("string")), **SPINE_RUN,
        )
    )
    return d.select("variant", version.alias("candidate_version"), "snapshot_sha256")


# ---------------------------------------------------------------- S5 S6 S7 S8 O3 U1
@register(
    "s5_snapshot_roundtrip",
    f"SELECT entity_id, feature_ts, signal_a, signal_b FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}'",
)
def s5_snapshot_roundtrip(spark, sf_dir):
    """S4 + S5: write the bounded feature snapshot once, read it back by declared schema."""
    path = scratch_path(spark, "snapshot")
    write_snapshot(bounded_feature_read(fx(spark, sf_dir, "fx_features"), cutoff=CUTOFF), path)
    return read_snapshot(spark, path, TRAINING_FEATURES)


@register(
    "s6_batch_membership",
    f"""
SELECT CAST(COUNT(*) AS BIGINT) AS rows,
       CAST(COUNT(*) FILTER (WHERE source_batch_id IS DISTINCT FROM '{SCORING_BATCH}') AS BIGINT) AS violations
FROM fx_scoring""",
)
def s6_batch_membership(spark, sf_dir):
    return batch_membership(fx(spark, sf_dir, "fx_scoring"), SCORING_BATCH)


def _manifest_sql() -> str:
    import hashlib

    h = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("scoring", SCORING_QUERY), ("training_features", FEATURES_QUERY), ("actuals", ACTUALS_QUERY))}
    return f"""
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM fx_scoring WHERE source_batch_id = '{SCORING_BATCH}' AND feature_ts <= TIMESTAMP '{SCORING_CUTOFF}') AS scoring_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM fx_features WHERE feature_ts <= TIMESTAMP '{CUTOFF}') AS training_features_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '{CUTOFF}') AS actuals_rows,
       '{h['scoring']}' AS scoring_query_sha256, '{h['training_features']}' AS training_features_query_sha256,
       '{h['actuals']}' AS actuals_query_sha256, '{SCORING_BATCH}' AS source_batch_id, '{CUTOFF}' AS source_cutoff,
       'manual' AS source_event_id, '{RUN_TS}' AS created_at"""


@register("s7_source_manifest", _manifest_sql())
def s7_source_manifest(spark, sf_dir):
    from pitloom.sources.snapshot import source_manifest

    pops = {
        "scoring": bounded_scoring_read(fx(spark, sf_dir, "fx_scoring"), batch_id=SCORING_BATCH, cutoff=SCORING_CUTOFF),
        "training_features": bounded_feature_read(fx(spark, sf_dir, "fx_features"), cutoff=CUTOFF),
        "actuals": bounded_actuals_read(fx(spark, sf_dir, "fx_actuals"), cutoff=CUTOFF),
    }
    texts = {"scoring": SCORING_QUERY, "training_features": FEATURES_QUERY, "actuals": ACTUALS_QUERY}
    return source_manifest(pops, texts, batch_id=SCORING_BATCH, cutoff=CUTOFF, event_id="manual", created_at=RUN_TS)


@register(
    "s8_prediction_csv_roundtrip",
    "SELECT entity_id, CAST(prediction_ts AS VARCHAR) AS prediction_ts, source_batch_id, correlation_id, prediction_class FROM fx_predictions",
)
def s8_prediction_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "scorer-csv")
    write_scorer_csv(fx(spark, sf_dir, "fx_predictions"), path)
    return read_scorer_csv(spark, path)


@register("s9_scoring_input", "SELECT entity_id, feature_ts, signal_a, signal_b, correlation_id, source_batch_id FROM fx_scoring")
def s9_scoring_input(spark, sf_dir):
    """The scoring rows handed over as Parquet and as CSV, read back as one population."""
    scoring = fx(spark, sf_dir, "fx_scoring")
    odd = F.col("correlation_id").cast("bigint") % 2 == 1
    paths = [scratch_path(spark, "scoring") + kind for kind in (".parquet", ".csv")]
    scoring.where(~odd).write.parquet(paths[0])
    scoring.where(odd).write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(paths[1])
    return read_scoring_input(spark, paths)


@register("o1_sorted_snapshot", "SELECT entity_id, feature_ts, signal_a, signal_b FROM fx_features")
def o1_sorted_snapshot(spark, sf_dir):
    """The feature snapshot, laid out by key ranges on write and read back."""
    path = scratch_path(spark, "sorted")
    write_sorted_snapshot(fx(spark, sf_dir, "fx_features"), path)
    return read_snapshot(spark, path, TRAINING_FEATURES)


@register(
    "p1_declared_columns",
    """
SELECT 'scoring' AS population, CAST(COUNT(*) AS BIGINT) AS rows, 'correlation_id,entity_id,feature_ts,signal_a,signal_b,source_batch_id' AS columns, '' AS label_columns FROM fx_scoring
UNION ALL SELECT 'training', CAST(COUNT(*) AS BIGINT), 'entity_id,feature_ts,signal_a,signal_b', '' FROM fx_features
UNION ALL SELECT 'actuals', CAST(COUNT(*) AS BIGINT), 'actual_quantity,correlation_id,entity_id,event_ts,label_available_ts', 'actual_quantity' FROM fx_actuals""",
)
def p1_declared_columns(spark, sf_dir):
    """P1 + P2: every population projected to its declared columns, and the label columns it would leak if it were scored."""
    declared = {
        "scoring": (fx(spark, sf_dir, "fx_scoring"), SCORING),
        "training": (fx(spark, sf_dir, "fx_features"), TRAINING_FEATURES),
        "actuals": (fx(spark, sf_dir, "fx_actuals"), ACTUALS),
    }
    out = None
    for name, frame in C.require_columns(declared).items():
        row = frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("population"), "rows", F.lit(",".join(sorted(frame.columns))).alias("columns"),
            F.lit(",".join(C.label_leak(frame.columns))).alias("label_columns"),
        )
        out = row if out is None else out.unionAll(row)
    return out


@register(
    "o3_input_example",
    "SELECT signal_a, signal_b FROM fx_features ORDER BY entity_id, feature_ts LIMIT 3",
)
def o3_input_example(spark, sf_dir):
    """O3: the first three predictor rows in key order (a top-k: the limit is the feature)."""
    f = fx(spark, sf_dir, "fx_features")
    return f.orderBy("entity_id", "feature_ts").limit(3).select("signal_a", "signal_b")


@register(
    "u1_union_by_name",
    """
SELECT entity_id, feature_ts, signal_a, signal_b, CAST(NULL AS VARCHAR) AS correlation_id, CAST(NULL AS VARCHAR) AS source_batch_id FROM fx_features
UNION ALL
SELECT entity_id, feature_ts, signal_a, signal_b, correlation_id, source_batch_id FROM fx_scoring""",
)
def u1_union_by_name(spark, sf_dir):
    a = fx(spark, sf_dir, "fx_features")
    b = fx(spark, sf_dir, "fx_scoring").select("source_batch_id", "correlation_id", *a.columns)
    return a.unionByName(b, allowMissingColumns=True)



