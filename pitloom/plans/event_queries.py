"""Registered queries: event parsing, reaction and the streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.functions.identity import retraining_job_name
from pitloom.plans import sqltext as Q
from pitloom.plans.registry import fx, register
from pitloom.session import scratch_path
from pitloom.streaming import events as E
from pitloom.streaming import monitor as M

RETRAIN_BATCH = "2000"
PRIOR_CUTOFF = "2024-01-08 00:00:00"

_PARSED_SQL = f"""
(SELECT event_id, ok, pid, event_type, dtype, run_id, run_status, breach_tag, event_time, event_ts,
        CASE WHEN NOT ok THEN 'invalid_json'
             WHEN pid IS NULL OR pid = '' THEN 'missing_id'
             WHEN event_type IS NULL THEN 'missing_event_type'
             WHEN dtype IS DISTINCT FROM 'OBJECT' THEN 'data_not_object'
             WHEN event_type = '{E.STATUS_EVENT}' AND (run_id IS NULL OR run_id = '') THEN 'missing_run_id'
             WHEN event_type = '{E.STATUS_EVENT}' AND (run_status IS NULL OR run_status = '') THEN 'missing_run_status'
             WHEN event_time IS NULL OR event_time = '' THEN 'missing_event_time'
             WHEN event_ts IS NULL THEN 'invalid_event_time'
        END AS dead_letter
 FROM (SELECT event_id, ok, event_time, TRY_CAST(event_time AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS event_ts,
              CASE WHEN ok AND json_type(body, '$.id') = 'VARCHAR' THEN json_extract_string(body, '$.id') END AS pid,
              CASE WHEN ok THEN COALESCE(NULLIF(json_extract_string(body, '$.eventType'), ''),
                                         NULLIF(json_extract_string(body, '$.EventType'), ''),
                                         NULLIF(json_extract_string(body, '$.type'), '')) END AS event_type,
              CASE WHEN ok THEN json_type(body, '$.data') END AS dtype,
              CASE WHEN ok THEN COALESCE(json_extract_string(body, '$.data.runId'), json_extract_string(body, '$.data.RunId')) END AS run_id,
              CASE WHEN ok THEN json_extract_string(body, '$.data.runStatus') END AS run_status,
              CASE WHEN ok THEN json_extract_string(body, '$.data.runTags.{E.BREACH_TAG}') END AS breach_tag
       FROM (SELECT event_id, body, ok, CASE WHEN ok THEN json_extract_string(body, '$.eventTime') END AS event_time
             FROM (SELECT event_id, body, json_valid(body) AS ok FROM fx_raw_events) v) r) q) p"""


def _parsed(spark, sf_dir):
    return E.parse_events(fx(spark, sf_dir, "fx_raw_events"))


@register(
    "t1_event_parse",
    f"SELECT pid AS event_id, event_type, event_time, event_ts, run_id, run_status, breach_tag FROM {_PARSED_SQL} WHERE dead_letter IS NULL",
)
def t1_event_parse(spark, sf_dir):
    p = _parsed(spark, sf_dir).where(F.col("dead_letter").isNull())
    event_ts = F.col("event_time_utc").alias("event_ts")
    return p.select(F.col("parsed_id").alias("event_id"), "event_type", "event_time", event_ts, "run_id", "run_status", "breach_tag")


@register(
    "t1_dead_letters",
    f"SELECT event_id, dead_letter AS reason FROM {_PARSED_SQL} WHERE dead_letter IS NOT NULL",
)
def t1_dead_letters(spark, sf_dir):
    p = _parsed(spark, sf_dir).where(F.col("dead_letter").isNotNull())
    return p.select("event_id", F.col("dead_letter").alias("reason"))


@register(
    "t2_breach_filter",
    f"""
SELECT pid AS event_id, run_id, breach_tag FROM {_PARSED_SQL}
WHERE dead_letter IS NULL AND event_type = '{E.STATUS_EVENT}' AND contains(lower(breach_tag), '{E.BREACH_PHRASE.lower()}')""",
)
def t2_breach_filter(spark, sf_dir):
    valid = _parsed(spark, sf_dir).where(F.col("dead_letter").isNull())
    return E.breach_filter(valid).select(F.col("parsed_id").alias("event_id"), "run_id", "breach_tag")


_RECHECK_SQL = f"""
(SELECT e.*, s.status AS authoritative_status, COALESCE(lower(s.status) = 'failed', FALSE) AS confirmed_failure
 FROM fx_run_events e LEFT JOIN fx_job_status s ON e.run_id = s.run_id) rc"""


@register(
    "t4_authoritative_recheck",
    f"SELECT event_id, run_id, run_status, authoritative_status, confirmed_failure FROM {_RECHECK_SQL} WHERE event_type = '{E.STATUS_EVENT}'",
)
def t4_authoritative_recheck(spark, sf_dir):
    ev = fx(spark, sf_dir, "fx_run_events").where(F.col("event_type") == E.STATUS_EVENT)
    r = E.recheck(ev, fx(spark, sf_dir, "fx_job_status"))
    return r.select("event_id", "run_id", "run_status", "authoritative_status", "confirmed_failure")


_JOB_SQL = "('retrain-' || substr(sha256(" + Q.json_object({"event_grid_event_id": "event_id"}) + "), 1, 24))"


@register(
    "t5_event_actions",
    f"""
SELECT event_id,
       CASE WHEN event_type <> '{E.STATUS_EVENT}' THEN 'LOG_ONLY'
            WHEN NOT confirmed_failure THEN 'IGNORE'
            WHEN breach_tag IS NULL OR regexp_matches(breach_tag, '^\\s*$') THEN 'LOG_FAILURE'
            WHEN event_ts < TIMESTAMP '{PRIOR_CUTOFF}' THEN 'ALREADY_HANDLED'
            ELSE 'SUBMIT_RETRAIN' END AS action,
       CASE WHEN event_type = '{E.STATUS_EVENT}' AND confirmed_failure
             AND NOT (breach_tag IS NULL OR regexp_matches(breach_tag, '^\\s*$')) THEN {_JOB_SQL} END AS retraining_job
FROM {_RECHECK_SQL}""",
)
def t5_event_actions(spark, sf_dir):
    """Decisions with automatic retraining on; jobs of status events before the prior
    cutoff were submitted by an earlier run (the request table J8 checks)."""
    ev = fx(spark, sf_dir, "fx_run_events")
    prior = ev.where(
        (F.col("event_type") == E.STATUS_EVENT) & (F.col("event_ts") < F.lit(PRIOR_CUTOFF).cast("timestamp_ntz"))
    ).select(retraining_job_name(F.col("event_id")).alias("job_name"))
    d = E.decide(E.recheck(ev, fx(spark, sf_dir, "fx_job_status")), prior, enable_auto_retrain=True, retraining_batch=RETRAIN_BATCH)
    return d.select("event_id", "action", "retraining_job")


# ---------------------------------------------------------------- the streaming job
def run_reactor(spark, sf_dir, runs: int = 1) -> E.EventReactor:
    """Deliveries -> JSON files in the shared folder -> the stream, one file a micro-batch, ``runs`` times (fresh checkpoints)."""
    source = scratch_path(spark, "deliveries")
    deliveries = fx(spark, sf_dir, "fx_deliveries").select("body", "delivered_ts", "attempt")
    deliveries.repartition(3).write.mode("errorifexists").option("timestampNTZFormat", E.TIME_FORMAT).json(source)
    reactor = E.EventReactor(
        spark,
        source=source,
        sink=scratch_path(spark, "reactions"),
        status=fx(spark, sf_dir, "fx_job_status"),
        enable_auto_retrain=True,
        retraining_batch=RETRAIN_BATCH,
        max_files_per_trigger=1,
    )
    for _ in range(runs):
        reactor.run(scratch_path(spark, "checkpoint"))
    return reactor


_ROUTED_SQL = f"""
(SELECT d.body, d.delivered_ts, d.attempt, p.pid AS event_id, p.event_type, p.event_time, p.event_ts, p.run_id, p.breach_tag,
        COALESCE(p.dead_letter, CASE WHEN d.delivered_ts > p.event_ts + INTERVAL 24 HOUR THEN 'expired' WHEN d.attempt > 12 THEN 'max_attempts' END) AS reason
 FROM fx_deliveries d JOIN {_PARSED_SQL} ON d.event_id = p.event_id) routed"""

_LIVE_SQL = f"(SELECT DISTINCT event_id, event_ts, event_time, event_type, run_id, breach_tag FROM {_ROUTED_SQL} WHERE reason IS NULL) live"

_REQUESTS_SQL = f"""
SELECT {_JOB_SQL.replace("event_id ||", "live.event_id ||")} AS job_name, live.event_id AS source_event_id, '{RETRAIN_BATCH}' AS source_batch_id,
       live.event_time AS source_cutoff
FROM {_LIVE_SQL} JOIN fx_job_status s ON live.run_id = s.run_id
WHERE live.event_type = '{E.STATUS_EVENT}' AND lower(s.status) = 'failed'
  AND NOT (live.breach_tag IS NULL OR regexp_matches(live.breach_tag, '^\\s*$'))"""

_DEAD_SQL = f"SELECT DISTINCT body, event_id, event_ts, delivered_ts, attempt, reason FROM {_ROUTED_SQL} WHERE reason IS NOT NULL"


@register("t3_dedupe_events", f"SELECT event_id, event_ts, event_type, run_id FROM {_LIVE_SQL}")
def t3_dedupe_events(spark, sf_dir):
    """At-least-once deliveries in, each live event handled exactly once out (stream)."""
    return run_reactor(spark, sf_dir).handled()


@register("t1_dead_letters_stream", _DEAD_SQL)
def t1_dead_letters_stream(spark, sf_dir):
    """Raw deliveries that break the contract or came too late, buried by the micro-batch that met them."""
    return run_reactor(spark, sf_dir).dead_letters().select("body", "event_id", "event_ts", "delivered_ts", "attempt", "reason")


@register("t6_retrain_requests", _REQUESTS_SQL)
def t6_retrain_requests(spark, sf_dir):
    return run_reactor(spark, sf_dir).requests()


@register("t6_retrain_replay", _REQUESTS_SQL)
def t6_retrain_replay(spark, sf_dir):
    """The whole delivery log processed twice (second run from a fresh checkpoint): no new requests."""
    return run_reactor(spark, sf_dir, runs=2).requests()


@register(
    "t7_late_events",
    f"SELECT event_id, event_ts, delivered_ts, attempt, reason FROM ({_DEAD_SQL}) dead WHERE reason IN ('expired', 'max_attempts')",
)
def t7_late_events(spark, sf_dir):
    """Deliveries past the lifetime or the attempts, of two runs over the same log: each once."""
    late = run_reactor(spark, sf_dir, runs=2).dead_letters().where(F.col("reason").isin("expired", "max_attempts"))
    return late.select("event_id", "event_ts", "delivered_ts", "attempt", "reason")


@register(
    "t8_daily_signals",
    f"""
SELECT date_trunc('day', event_ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS window_start,
       date_trunc('day', event_ts - INTERVAL 6 HOUR) + INTERVAL 30 HOUR AS window_end,
       CAST(COUNT(*) AS BIGINT) AS events,
       CAST(COUNT(*) FILTER (WHERE event_type = '{E.STATUS_EVENT}') AS BIGINT) AS status_events,
       CAST(COUNT(*) FILTER (WHERE event_type = '{E.STATUS_EVENT}' AND NOT (breach_tag IS NULL OR regexp_matches(breach_tag, '^\\s*$'))) AS BIGINT) AS breach_events,
       ROUND(COUNT(*) FILTER (WHERE event_type = '{E.STATUS_EVENT}' AND NOT (breach_tag IS NULL OR regexp_matches(breach_tag, '^\\s*$'))) * 1.0 / COUNT(*), 12) AS breach_share
FROM fx_run_events GROUP BY 1, 2""",
)
def t8_daily_signals(spark, sf_dir):
    """The run events as files -> the windowed stream (update mode) -> latest per window."""
    source = scratch_path(spark, "run-events")
    fx(spark, sf_dir, "fx_run_events").repartition(3).write.mode("errorifexists").parquet(source)
    sink = scratch_path(spark, "daily-signals")
    E.run_daily_signals(spark, source, sink, scratch_path(spark, "checkpoint"), max_files_per_trigger=1)
    return E.daily_signals_current(spark, sink)


# ---------------------------------------------------------------- T8 feeding A7-A10
REFERENCE_END = "1999-01-01 00:00:00"
#: Fixed bin edges of the monitored features.
EDGES = {"signal_a": (0.0, 500000.0), "signal_b": (0.0, 97.0)}
_MONITOR_SCHEMA = "scored_ts timestamp_ntz, signal_a double, signal_b double, prediction_class string, actual_class string"


def _daily_sql() -> str:
    bins = " UNION ALL ".join(
        f"SELECT day, old, 'bin' AS kind, '{f}' AS subject, "
        f"CAST(CAST(GREATEST(LEAST(FLOOR(({f} - {lo}) / {hi - lo} * 10), 9), 0) AS BIGINT) AS VARCHAR) AS value FROM rows WHERE {f} IS NOT NULL"
        for f, (lo, hi) in EDGES.items()
    )
    return f"""
WITH rows AS (
  SELECT *, date_trunc('day', scored_ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS day, scored_ts < TIMESTAMP '{REFERENCE_END}' AS old FROM fx_monitor),
long AS (
  SELECT day, old, 'class' AS kind, 'prediction_class' AS subject, prediction_class AS value FROM rows UNION ALL {bins}),
ref AS (SELECT kind, subject, value, COUNT(*) AS p FROM long WHERE old GROUP BY ALL),
cur AS (SELECT day, kind, subject, value, COUNT(*) AS q FROM long WHERE NOT old GROUP BY ALL),
grid AS (
  SELECT d.day, r.kind, r.subject, r.value FROM (SELECT DISTINCT day, kind, subject FROM cur) d JOIN ref r USING (kind, subject)
  UNION SELECT day, kind, subject, value FROM cur),
cells AS (
  SELECT day, kind, subject, value, COALESCE(p, 0) AS p, COALESCE(q, 0) AS q,
         SUM(COALESCE(p, 0)) OVER w AS sp, SUM(COALESCE(q, 0)) OVER w AS sq
  FROM grid LEFT JOIN ref USING (kind, subject, value) LEFT JOIN cur USING (day, kind, subject, value)
  WINDOW w AS (PARTITION BY day, kind, subject)),
shares AS (SELECT *, p * 1.0 / sp AS a, q * 1.0 / sq AS b FROM cells),
found AS (
  SELECT day, kind, subject, 0.5 * SUM(ABS(a - b)) AS tv,
         SQRT(GREATEST(SUM(0.5 * CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END
                         + 0.5 * CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END), 0)) AS js,
         SUM(POWER(p - (p + q) * sp * 1.0 / (sp + sq), 2) / ((p + q) * sp * 1.0 / (sp + sq))
           + POWER(q - (p + q) * sq * 1.0 / (sp + sq), 2) / ((p + q) * sq * 1.0 / (sp + sq))) AS statistic,
         COUNT(*) - 1 AS df
  FROM shares GROUP BY ALL)
SELECT day AS window_start, 'total_variation' AS signal, subject, ROUND(tv, 9) AS value FROM found WHERE kind = 'class'
UNION ALL SELECT day, 'chi_squared', subject, ROUND(statistic, 6) FROM found WHERE kind = 'class'
UNION ALL SELECT day, 'chi_squared_p_value', subject, ROUND({Q.chi2_survival('statistic', 'df')}, 6) FROM found WHERE kind = 'class' AND df > 0
UNION ALL SELECT day, 'jensen_shannon_distance', subject, ROUND(js, 9) FROM found WHERE kind = 'bin'
UNION ALL SELECT day, 'delayed_accuracy', 'prediction_class', ROUND(AVG(CASE WHEN actual_class = prediction_class THEN 1.0 ELSE 0.0 END), 9)
FROM rows WHERE NOT old AND actual_class IS NOT NULL GROUP BY day"""


@register("t8_daily_drift", _daily_sql())
def t8_daily_drift(spark, sf_dir):
    """Scored rows as files -> the counting stream, one file a micro-batch, twice over -> drift and accuracy of each 06:00 day."""
    scored = fx(spark, sf_dir, "fx_monitor")
    old = F.col("scored_ts") < F.lit(REFERENCE_END).cast("timestamp_ntz")
    source, log = scratch_path(spark, "scored"), scratch_path(spark, "daily-counts")
    scored.where(~old).repartition(3).write.parquet(source)
    for _ in range(2):  # the second run meets the same files with a fresh checkpoint, as after a lost one
        M.run_daily_counts(
            spark, source, log, scratch_path(spark, "checkpoint"), schema=_MONITOR_SCHEMA, ts="scored_ts", features=EDGES, max_files_per_trigger=1
        )
    reference = M.partial_counts(scored.where(old), [], features=EDGES).where(F.col("kind") != M.LABEL)
    drift = M.daily_drift(M.daily_counts(spark, log), reference)
    digits = F.when(F.col("signal").startswith("chi_squared"), F.round("value", 6)).otherwise(F.round("value", 9))
    return drift.select("window_start", "signal", "subject", digits.alias("value"))
