"""Registered queries: metrics, drift, monitor verdict, promotion gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.operators import drift as D
from pitloom.operators import gate as G
from pitloom.operators import metrics as M
from pitloom.operators.reconcile import delayed_label_join
from pitloom.plans import sqltext as Q
from pitloom.plans.join_queries import training_spine
from pitloom.plans.quality_queries import candidate_artifacts
from pitloom.plans.registry import MAPPING_VERSION, MODEL_NAME, fx, register
from pitloom.session import ensure_checkpoint_dir

SEED = 17


def _scored_truth(spark, sf_dir):
    return delayed_label_join(fx(spark, sf_dir, "fx_scored"), fx(spark, sf_dir, "fx_truth"))


_JOINED = "(SELECT s.correlation_id, s.prediction_class, s.p_class_1, t.actual_class FROM fx_scored s JOIN fx_truth t ON s.correlation_id = t.correlation_id) j"


@register(
    "a2_distinct_batches",
    "SELECT array_to_string(list_sort(list(DISTINCT source_batch_id)), ',') AS source_batch_ids, "
    "CAST(COUNT(DISTINCT source_batch_id) AS BIGINT) AS batches FROM fx_predictions",
)
def a2_distinct_batches(spark, sf_dir):
    p = fx(spark, sf_dir, "fx_predictions").select("source_batch_id").distinct()
    # The set of batch ids is bounded by the number of batches, not by rows.
    ids = F.sort_array(F.collect_set("source_batch_id"))
    return p.agg(F.array_join(ids, ",").alias("source_batch_ids"), F.count(F.lit(1)).alias("batches"))


@register(
    "a3_class_support",
    """
SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(DISTINCT quantity_class) AS BIGINT) AS classes,
       COUNT(*) >= 12 AND COUNT(DISTINCT quantity_class) >= 2 AS ok
FROM (SELECT CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class
      FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '2000-06-30 00:00:00') a
      ASOF JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '2000-06-30 00:00:00') f
        ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts
      WHERE f.feature_ts >= a.event_ts - INTERVAL 30 DAY) t""",
)
def a3_class_support(spark, sf_dir):
    spine = training_spine(spark, sf_dir).where(F.col("feature_ts").isNotNull())
    return M.class_support(spine, "quantity_class")


@register(
    "a4_accuracy",
    f"SELECT ROUND(AVG(CASE WHEN prediction_class = actual_class THEN 1.0 ELSE 0.0 END), 12) AS accuracy, CAST(COUNT(*) AS BIGINT) AS rows FROM {_JOINED}",
)
def a4_accuracy(spark, sf_dir):
    j = _scored_truth(spark, sf_dir)
    return j.agg(F.round(M.accuracy(j, "prediction_class", "actual_class"), 12).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


_CONF_SQL = f"""
(SELECT cls AS class, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn
 FROM (SELECT actual_class AS cls, 1 AS tp, 0 AS fp, 0 AS fn FROM {_JOINED} WHERE prediction_class = actual_class
       UNION ALL SELECT prediction_class, 0, 1, 0 FROM {_JOINED} WHERE prediction_class <> actual_class
       UNION ALL SELECT actual_class, 0, 0, 1 FROM {_JOINED} WHERE prediction_class <> actual_class) e
 GROUP BY cls) c"""


@register(
    "a5_confusion",
    f"SELECT class, tp, fp, fn, tp + fn AS support, ROUND(2.0 * tp / (2 * tp + fp + fn), 12) AS f1 FROM {_CONF_SQL}",
)
def a5_confusion(spark, sf_dir):
    c = M.confusion(_scored_truth(spark, sf_dir), "prediction_class", "actual_class")
    return c.withColumn("f1", F.round("f1", 12))


@register(
    "a5_macro_f1",
    f"SELECT ROUND(AVG(2.0 * tp / (2 * tp + fp + fn)), 12) AS macro_f1, CAST(COUNT(*) AS BIGINT) AS classes FROM {_CONF_SQL}",
)
def a5_macro_f1(spark, sf_dir):
    c = M.confusion(_scored_truth(spark, sf_dir), "prediction_class", "actual_class")
    return M.macro_f1(c).withColumn("macro_f1", F.round("macro_f1", 12))


_P_TRUE_SQL = "CASE WHEN actual_class = '1' THEN p_class_1 ELSE 1 - p_class_1 END"


@register(
    "a6_log_loss",
    f"SELECT ROUND(AVG(-ln(GREATEST(LEAST({_P_TRUE_SQL}, 1 - 1e-15), 1e-15))), 9) AS log_loss FROM {_JOINED}",
)
def a6_log_loss(spark, sf_dir):
    j = _scored_truth(spark, sf_dir)
    p_true = F.when(F.col("actual_class") == "1", F.col("p_class_1")).otherwise(1 - F.col("p_class_1"))
    return j.agg(F.round(M.log_loss(p_true), 9).alias("log_loss"))


_SHARES_SQL = """
(SELECT prediction_class, side, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY side) AS share
 FROM fx_drift GROUP BY prediction_class, side) s"""


@register(
    "a7_total_variation",
    f"""
SELECT ROUND(0.5 * SUM(ABS(p - q)), 12) AS total_variation FROM (
  SELECT prediction_class, SUM(CASE WHEN side = 'reference' THEN share ELSE 0 END) AS p,
         SUM(CASE WHEN side = 'current' THEN share ELSE 0 END) AS q
  FROM {_SHARES_SQL} GROUP BY prediction_class) t""",
)
def a7_total_variation(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_drift")
    return M.total_variation(d, "side", "prediction_class").withColumn("total_variation", F.round("total_variation", 12))


_JS_SQL = """
(SELECT feature, SQRT(GREATEST(SUM(
        0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
      + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 0)) AS js_distance
 FROM (SELECT feature, bin, SUM(CASE WHEN side = 'reference' THEN share ELSE 0 END) AS p,
              SUM(CASE WHEN side = 'current' THEN share ELSE 0 END) AS q
       FROM (SELECT feature, side, bin, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY feature, side) AS share
             FROM (SELECT feature, side,
                          CASE WHEN hi = lo THEN 0 ELSE CAST(LEAST(FLOOR((value - lo) / (hi - lo) * 10), 9) AS INTEGER) END AS bin
                   FROM (SELECT *, MIN(value) OVER (PARTITION BY feature) AS lo, MAX(value) OVER (PARTITION BY feature) AS hi
                         FROM (SELECT side, 'signal_a' AS feature, signal_a AS value FROM fx_drift
                               UNION ALL SELECT side, 'signal_b', signal_b FROM fx_drift) v
                         WHERE value IS NOT NULL AND NOT isnan(value)) e) b
             GROUP BY feature, side, bin) s
       GROUP BY feature, bin) pq
 GROUP BY feature) js"""


@register("a8_js_distance", f"SELECT feature, ROUND(js_distance, 9) AS js_distance FROM {_JS_SQL}")
def a8_js_distance(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_drift")
    return D.js_distance(d, "side", ["signal_a", "signal_b"]).withColumn("js_distance", F.round("js_distance", 9))


_CHI_SQL = """
(SELECT SUM((COALESCE(o.o, 0) - g.e) * (COALESCE(o.o, 0) - g.e) / g.e) AS statistic,
        CAST((COUNT(DISTINCT g.side) - 1) * (COUNT(DISTINCT g.prediction_class) - 1) AS BIGINT) AS df
 FROM (SELECT r.side, c.prediction_class, r.rn * c.cn * 1.0 / r.n AS e
       FROM (SELECT side, COUNT(*) AS rn, SUM(COUNT(*)) OVER () AS n FROM fx_drift GROUP BY side) r,
            (SELECT prediction_class, COUNT(*) AS cn FROM fx_drift GROUP BY prediction_class) c) g
 LEFT JOIN (SELECT side, prediction_class, COUNT(*) AS o FROM fx_drift GROUP BY side, prediction_class) o
   ON g.side = o.side AND g.prediction_class = o.prediction_class) chi"""


@register("a9_chi_squared", f"SELECT ROUND(statistic, 6) AS statistic, df FROM {_CHI_SQL}")
def a9_chi_squared(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_drift")
    return D.chi_squared(d, "side", "prediction_class").withColumn("statistic", F.round("statistic", 6))


@register(
    "a9_chi_squared_p",
    f"SELECT ROUND({Q.chi2_survival('statistic', 'df')}, 9) AS p_value, ROUND(statistic, 6) AS statistic, df FROM {_CHI_SQL}",
)
def a9_chi_squared_p(spark, sf_dir):
    r = D.chi_squared_p_value(fx(spark, sf_dir, "fx_drift"), "side", "prediction_class")
    return r.select(F.round("p_value", 9).alias("p_value"), F.round("statistic", 6).alias("statistic"), "df")


#: Classes of the drift table with 1, 3, 4 and 7 degrees of freedom.
_BY_DF = {"parity": "CAST(row_id % 2 AS STRING)", "quarter": "CAST(row_id % 4 AS STRING)", "priority": "prediction_class", "octave": "CAST(row_id % 8 AS STRING)"}


def _any_df_sql() -> str:
    parts = []
    for subject, cls in _BY_DF.items():
        chi = _CHI_SQL.replace("FROM fx_drift", f"FROM (SELECT side, {cls.replace('STRING', 'VARCHAR')} AS prediction_class FROM fx_drift) d")
        parts.append(f"SELECT '{subject}' AS subject, ROUND(statistic, 6) AS statistic, df, ROUND({Q.chi2_survival('statistic', 'df')}, 9) AS p_value FROM {chi}")
    return "\nUNION ALL\n".join(parts)


@register("a9_chi_squared_p_any_df", _any_df_sql())
def a9_chi_squared_p_any_df(spark, sf_dir):
    """The p-value for odd and even degrees of freedom, in the one-row table of each statistic."""
    out = None
    for subject, cls in _BY_DF.items():
        d = fx(spark, sf_dir, "fx_drift").select("side", F.expr(cls).alias("cls"))
        r = D.chi_squared_p_value(d, "side", "cls").select(
            F.lit(subject).alias("subject"), F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 9).alias("p_value")
        )
        out = r if out is None else out.unionAll(r)
    return out


@register(
    "a10_delayed_accuracy",
    f"""
SELECT CAST(COUNT(*) AS BIGINT) AS predictions, CAST(COUNT(t.correlation_id) AS BIGINT) AS labelled,
       ROUND(AVG(CASE WHEN t.correlation_id IS NULL THEN NULL WHEN s.prediction_class = t.actual_class THEN 1.0 ELSE 0.0 END), 12) AS accuracy,
       AVG(CASE WHEN t.correlation_id IS NULL THEN NULL WHEN s.prediction_class = t.actual_class THEN 1.0 ELSE 0.0 END) < {D.ACCURACY_THRESHOLD} AS alert
FROM fx_scored s LEFT JOIN fx_truth t ON s.correlation_id = t.correlation_id""",
)
def a10_delayed_accuracy(spark, sf_dir):
    """J6 (left, for coverage) -> A4 on the labelled rows -> threshold."""
    truth = fx(spark, sf_dir, "fx_truth")
    j = fx(spark, sf_dir, "fx_scored").join(truth, "correlation_id", "left")
    acc = F.avg(F.when(F.col("actual_class").isNotNull(), (F.col("prediction_class") == F.col("actual_class")).cast("double")))
    return j.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("actual_class").alias("labelled"),
        F.round(acc, 12).alias("accuracy"),
        (acc < F.lit(D.ACCURACY_THRESHOLD)).alias("alert"),
    )


def monitor_signals(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_drift")
    js = D.js_distance(d, "side", ["signal_a", "signal_b"]).select(
        F.lit("jensen_shannon_distance").alias("signal"), F.col("feature").alias("subject"), F.col("js_distance").alias("value")
    )
    tv = M.total_variation(d, "side", "prediction_class").select(
        F.lit("total_variation").alias("signal"), F.lit("prediction_class").alias("subject"), F.col("total_variation").alias("value")
    )
    chi = D.chi_squared_p_value(d, "side", "prediction_class").select(
        F.lit("chi_squared_p_value").alias("signal"),
        F.lit("prediction_class").alias("subject"),
        F.col("p_value").alias("value"),
    )
    j = _scored_truth(spark, sf_dir)
    acc = j.agg(M.accuracy(j, "prediction_class", "actual_class").alias("value")).select(
        F.lit("delayed_accuracy").alias("signal"), F.lit("prediction_class").alias("subject"), "value"
    )
    return D.signal_rows({"js": js, "tv": tv, "chi": chi, "acc": acc})


@register(
    "a11_monitor_verdict",
    f"""
SELECT signal, subject, ROUND(value, 9) AS value, threshold,
       CASE WHEN signal IN ('jensen_shannon_distance', 'total_variation') THEN value >= threshold ELSE value < threshold END AS alert
FROM (
  SELECT 'jensen_shannon_distance' AS signal, feature AS subject, js_distance AS value, {D.JS_THRESHOLD} AS threshold FROM {_JS_SQL}
  UNION ALL
  SELECT 'total_variation', 'prediction_class', 0.5 * SUM(ABS(p - q)), {D.TV_THRESHOLD} FROM (
    SELECT prediction_class, SUM(CASE WHEN side = 'reference' THEN share ELSE 0 END) AS p,
           SUM(CASE WHEN side = 'current' THEN share ELSE 0 END) AS q FROM {_SHARES_SQL} GROUP BY prediction_class) t
  UNION ALL
  SELECT 'chi_squared_p_value', 'prediction_class',
         {Q.chi2_survival('statistic', 'df')}, {D.P_VALUE_THRESHOLD} FROM {_CHI_SQL}
  UNION ALL
  SELECT 'delayed_accuracy', 'prediction_class', AVG(CASE WHEN prediction_class = actual_class THEN 1.0 ELSE 0.0 END), {D.ACCURACY_THRESHOLD} FROM {_JOINED}
) s""",
)
def a11_monitor_verdict(spark, sf_dir):
    v = D.verdict(monitor_signals(spark, sf_dir), D.DEFAULT_THRESHOLDS)
    return v.withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- gate
def _gate_inputs(spark, sf_dir):
    cand_metrics = fx(spark, sf_dir, "fx_candidate_metrics")
    champ = fx(spark, sf_dir, "fx_champion_metrics")
    champions = fx(spark, sf_dir, "fx_champions")
    rules = G.rules_from_table(fx(spark, sf_dir, "fx_rules"))
    candidates = candidate_artifacts(spark, sf_dir)
    return candidates, cand_metrics, champions, champ, rules


_GATE_REASONS_SQL = """
(WITH c AS (SELECT DISTINCT model_version, segment FROM fx_candidate_metrics),
 pr AS (SELECT c.model_version, c.segment, r.rule_no, r.metric, r.direction, r.threshold, r.minimum_delta,
               cm.value AS cand, ch.value AS champ, hc.segment IS NOT NULL AS has_champion
        FROM c CROSS JOIN fx_rules r
        LEFT JOIN fx_candidate_metrics cm ON cm.model_version = c.model_version AND cm.segment = c.segment AND cm.metric = r.metric
        LEFT JOIN fx_champion_metrics ch ON ch.segment = c.segment AND ch.metric = r.metric
        LEFT JOIN fx_champions hc ON hc.segment = c.segment)
 SELECT model_version, segment, rule_no, 1 AS seq,
        CASE WHEN cand IS NULL THEN 'missing_candidate_metric:' || metric
             WHEN isnan(cand) OR isinf(cand) THEN 'nonfinite_candidate_metric:' || metric
             WHEN NOT (CASE WHEN direction = 'maximize' THEN cand >= threshold ELSE cand <= threshold END)
               THEN 'candidate_threshold_failed:' || metric END AS reason
 FROM pr
 UNION ALL
 SELECT model_version, segment, rule_no, 2,
        CASE WHEN cand IS NOT NULL AND NOT isnan(cand) AND NOT isinf(cand) AND has_champion THEN
          CASE WHEN champ IS NULL THEN 'missing_champion_metric:' || metric
               WHEN isnan(champ) OR isinf(champ) THEN 'nonfinite_champion_metric:' || metric
               WHEN (CASE WHEN direction = 'maximize' THEN cand - champ ELSE champ - cand END) < minimum_delta
                 THEN 'improvement_below_minimum_delta:' || metric END END
 FROM pr)"""


@register(
    "a12_gate_reasons",
    f"SELECT model_version, segment, rule_no, seq, reason FROM {_GATE_REASONS_SQL} g WHERE reason IS NOT NULL",
)
def a12_gate_reasons(spark, sf_dir):
    candidates, cand_metrics, champions, champ, rules = _gate_inputs(spark, sf_dir)
    return G.gate_reasons(candidates.select("model_version", "segment"), cand_metrics, champions, champ, rules)


_ART_MAPPING = "CASE WHEN segment = 3 THEN 'quantity-v2' WHEN segment = 4 THEN NULL ELSE 'quantity-v1' END"
_OUTCOME_SQL = f"""
(SELECT c.model_version, c.segment,
        CASE WHEN (({_ART_MAPPING.replace('segment', 'c.segment')}) IS NULL OR hc.segment IS NOT NULL AND ({_ART_MAPPING.replace('segment', 'c.segment')}) IS DISTINCT FROM hc.champion_mapping) THEN 'HALT'
             WHEN r.n IS NULL THEN 'PROMOTE' WHEN hc.segment IS NOT NULL THEN 'RETAIN' ELSE 'HALT' END AS outcome,
        CAST(CASE WHEN (({_ART_MAPPING.replace('segment', 'c.segment')}) IS NULL OR hc.segment IS NOT NULL AND ({_ART_MAPPING.replace('segment', 'c.segment')}) IS DISTINCT FROM hc.champion_mapping) THEN 1
             WHEN r.n IS NULL THEN 0 WHEN hc.segment IS NOT NULL THEN r.n ELSE r.n + 1 END AS BIGINT) AS n_reasons,
        CASE WHEN (({_ART_MAPPING.replace('segment', 'c.segment')}) IS NULL OR hc.segment IS NOT NULL AND ({_ART_MAPPING.replace('segment', 'c.segment')}) IS DISTINCT FROM hc.champion_mapping) THEN 'mapping_version_mismatch'
             WHEN r.n IS NULL THEN '' WHEN hc.segment IS NOT NULL THEN r.reasons
             ELSE r.reasons || ';no_production_deployment' END AS reasons
 FROM (SELECT DISTINCT model_version, segment FROM fx_candidate_metrics) c
 LEFT JOIN (SELECT model_version, segment, COUNT(*) AS n, string_agg(reason, ';' ORDER BY rule_no, seq) AS reasons
            FROM {_GATE_REASONS_SQL} g WHERE reason IS NOT NULL GROUP BY model_version, segment) r
   ON r.model_version = c.model_version AND r.segment = c.segment
 LEFT JOIN fx_champions hc ON hc.segment = c.segment) o"""


def gate_outcomes(spark, sf_dir):
    candidates, cand_metrics, champions, champ, rules = _gate_inputs(spark, sf_dir)
    reasons = G.gate_reasons(candidates.select("model_version", "segment"), cand_metrics, champions, champ, rules)
    return G.gate_outcome(candidates, reasons, champions)


@register("a12_gate_outcome", f"SELECT model_version, segment, outcome, n_reasons, reasons FROM {_OUTCOME_SQL}")
def a12_gate_outcome(spark, sf_dir):
    return gate_outcomes(spark, sf_dir)


@register(
    "m5_selected_model",
    f"""
SELECT model_version, segment, outcome, n_reasons, reasons,
       CASE WHEN outcome = 'PROMOTE' THEN model_version WHEN outcome = 'RETAIN' THEN 'champion-' || CAST(segment AS VARCHAR) END AS selected_version
FROM {_OUTCOME_SQL}""",
)
def m5_selected_model(spark, sf_dir):
    champions = fx(spark, sf_dir, "fx_champions").select("segment", "champion_version")
    return G.selected_model(gate_outcomes(spark, sf_dir), champions)


@register(
    "m4_model_registry",
    f"""
SELECT '{MODEL_NAME}' AS model_name, c.model_version, c.segment, {_ART_MAPPING.replace('segment', 'c.segment')} AS mapping_version,
       MAX(CASE WHEN metric = 'macro_f1' THEN value END) AS metric_macro_f1,
       MAX(CASE WHEN metric = 'log_loss' THEN value END) AS metric_log_loss,
       'candidate' AS lifecycle
FROM fx_candidate_metrics c GROUP BY c.model_version, c.segment""",
)
def m4_model_registry(spark, sf_dir):
    """M4: every candidate with its metrics (one column per rule metric) and provenance."""
    from pitloom.operators.registry import registry_rows

    return registry_rows(candidate_artifacts(spark, sf_dir), fx(spark, sf_dir, "fx_candidate_metrics"), MODEL_NAME, ["macro_f1", "log_loss"])


@register(
    "m2_constant_baseline",
    "SELECT entity_id, correlation_id, '1' AS prediction_class FROM fx_scoring",
)
def m2_constant_baseline(spark, sf_dir):
    from pitloom.operators.scoring import constant_baseline

    return constant_baseline(fx(spark, sf_dir, "fx_scoring"), "1").select("entity_id", "correlation_id", "prediction_class")


@register(
    "w2_stratified_split",
    """
SELECT correlation_id, quantity_class,
       CASE WHEN row_number() OVER (PARTITION BY quantity_class ORDER BY sha256('17|' || correlation_id))
                 <= (COUNT(*) OVER (PARTITION BY quantity_class) + 3) // 4
                 AND COUNT(*) OVER (PARTITION BY quantity_class) > 1 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT a.correlation_id, CAST(CAST(a.actual_quantity AS BIGINT) AS VARCHAR) AS quantity_class
      FROM (SELECT * FROM fx_actuals WHERE label_available_ts <= TIMESTAMP '2000-06-30 00:00:00') a
      ASOF JOIN (SELECT * FROM fx_features WHERE feature_ts <= TIMESTAMP '2000-06-30 00:00:00') f
        ON a.entity_id = f.entity_id AND a.event_ts >= f.feature_ts
      WHERE f.feature_ts >= a.event_ts - INTERVAL 30 DAY) t""",
)
def w2_stratified_split(spark, sf_dir):
    spine = training_spine(spark, sf_dir).where(F.col("feature_ts").isNotNull()).select("correlation_id", "quantity_class")
    # The split reads its rows three times (counts, whole buckets, the cut's buckets): the derived spine is written once.
    ensure_checkpoint_dir(spark)
    return M.stratified_split(spine.checkpoint(eager=True), "quantity_class", ["correlation_id"], seed=SEED)
