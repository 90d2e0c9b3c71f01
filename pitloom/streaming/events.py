"""Reacting to monitor events, at least once in, exactly once out.

The per-event logic is a set of ``DataFrame -> DataFrame`` functions usable on a
batch or inside a stream:

* T1 ``parse_events``: JSON payload -> typed event or dead-letter reason. Top-level
  keys and keys inside ``data`` ignore case (the last of two case-variants wins);
  the ``data`` key itself is exact.
* T2 ``breach_filter``: the subscription filter (type, then breach phrase, any case).
* T4 ``recheck``: stream-static join with the authoritative run status.
* T5 ``decide``: LOG_ONLY -> IGNORE -> LOG_FAILURE -> LOG_ONLY -> ALREADY_HANDLED ->
  SUBMIT_RETRAIN, first match wins.
* T6 ``retraining_requests``: one request per deterministic job name.
* T7 ``route_expired``: deliveries past the 24-hour lifetime or 12 attempts.
* T8 ``daily_signals``: per tumbling day starting 06:00.

``EventReactor`` is the Structured Streaming job: a source of raw JSON deliveries -> ``foreachBatch`` that parses, buries what
breaks the contract or has expired, keeps one delivery per event id, rechecks, decides and appends requests with an
anti-join on the job name, so a replayed batch or a second run adds nothing. No watermark is set: a backlog may
come in any order and any number of micro-batches without losing a row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.identity import is_blank, retraining_job_name, utc_ntz

# Event contract of the monitor.
STATUS_EVENT = "Microsoft.MachineLearningServices.RunStatusChanged"
BREACH_TAG = "azureml_modelmonitor_threshold_breached"
BREACH_PHRASE = "has failed due to one or more features violating metric thresholds"
EVENT_TTL = "24 hours"
MAX_ATTEMPTS = 12

IGNORE, LOG_ONLY, LOG_FAILURE, SUBMIT, HANDLED = (
    "IGNORE",
    "LOG_ONLY",
    "LOG_FAILURE",
    "SUBMIT_RETRAIN",
    "ALREADY_HANDLED",
)


#: A time as events carry it: a date, and a time of day with an optional fraction and offset.
_TIME = (
    r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?"
    r"([zZ]|[+-](0[0-9]|1[0-7]):?[0-5][0-9])?$"
    r"|^[0-9]{4}-((0[13578]|1[02])-(29|30|31)|(0[469]|11)-(29|30))[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?"
    r"([zZ]|[+-](0[0-9]|1[0-7]):?[0-5][0-9])?$"
)


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def _folded(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))


def _text(v: Column) -> Column:
    """The value when it is a JSON string, else null (a number is not a string)."""
    return F.when(F.schema_of_variant(v) == F.lit("STRING"), F.variant_get(v, "$", "string"))


def _object(v: Column) -> Column:
    """The value as a map when it is a JSON object, else null."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.variant_get(v, "$", "map<string,variant>"))


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds parsed_id, event_type, event_time (the event's own text, the retraining cutoff), event_time_utc, run_id,
    run_status, breach_tag and ``dead_letter`` (reason or null).

    Values are parsed as variants, so a required field must be a non-empty JSON string
    (a number is refused) and ``data`` must be a JSON object.
    """
    # Each step binds what the next one uses several times: a text is parsed once, a map folded once. The one-row ``inline``
    # at the end keeps filters on the results from pulling the whole parse into themselves.
    def step(rows: Column, fields) -> Column:
        return F.transform(rows, lambda r: F.struct(*[value.alias(name) for name, value in fields(r).items()]))

    def also(r: Column, *names: str) -> dict[str, Column]:
        return {n: r[n] for n in names}

    out = step(F.array(F.from_json(F.col(body), "map<string,variant>")), lambda m: {"event": m, "folded": _folded(m), "data": _object(m["data"])})
    out = step(out, lambda r: {**also(r, "event", "folded", "data"), "dfold": _folded(r["data"])})
    out = step(
        out,
        lambda r: {
            **also(r, "event", "data"),
            "parsed_id": _text(r["folded"]["id"]),
            "type": _text(r["folded"]["eventtype"]),
            "other_type": _text(r["folded"]["type"]),
            "event_time": _text(r["folded"]["eventtime"]),
            "run_id": _text(r["dfold"]["runid"]),
            "run_status": _text(r["dfold"]["runstatus"]),
            "tags": _folded(_object(r["dfold"]["runtags"])),
        },
    )
    out = step(
        out,
        lambda r: {
            **also(r, "event", "data", "parsed_id", "event_time", "run_id", "run_status"),
            "event_type": F.coalesce(*[F.when(_present(r[t]), r[t]) for t in ("type", "other_type")]),
            "event_time_utc": utc_ntz(F.when(r["event_time"].rlike(_TIME), r["event_time"]), T.StringType()),
            "breach_tag": _text(r["tags"][BREACH_TAG]),
        },
    )
    out = step(
        out,
        lambda r: {
            **also(r, "parsed_id", "event_type", "event_time", "event_time_utc", "run_id", "run_status", "breach_tag"),
            "dead_letter": _broken_rule(r),
        },
    )
    return raw.select("*", F.inline(out))


def _broken_rule(r: Column) -> Column:
    """The first rule that a parsed event breaks, or null."""
    is_status = r["event_type"] == F.lit(STATUS_EVENT)
    return (
        F.when(r["event"].isNull(), F.lit("invalid_json"))
        .when(~_present(r["parsed_id"]), F.lit("missing_id"))
        .when(r["event_type"].isNull(), F.lit("missing_event_type"))
        .when(r["data"].isNull(), F.lit("data_not_object"))
        .when(is_status & ~_present(r["run_id"]), F.lit("missing_run_id"))
        .when(is_status & ~_present(r["run_status"]), F.lit("missing_run_status"))
        .when(~_present(r["event_time"]), F.lit("missing_event_time"))
        .when(r["event_time_utc"].isNull(), F.lit("invalid_event_time"))
    )


def breach_filter(events: DataFrame) -> DataFrame:
    """Status events whose breach tag contains the phrase (case-insensitive)."""
    return events.where(
        (F.col("event_type") == STATUS_EVENT) & F.lower(F.col("breach_tag")).contains(BREACH_PHRASE.lower())
    )


def recheck(events: DataFrame, status: DataFrame) -> DataFrame:
    """Authoritative status per run (stream-static left join)."""
    s = status.select("run_id", F.col("status").alias("authoritative_status"))
    return events.join(s, "run_id", "left").withColumn(
        "confirmed_failure", F.coalesce(F.lower(F.col("authoritative_status")) == "failed", F.lit(False))
    )


def decide(
    events: DataFrame,
    requests: DataFrame | None,
    *,
    enable_auto_retrain: bool,
    retraining_batch: str | None,
) -> DataFrame:
    """T5: action per event; ``events`` must carry ``confirmed_failure`` (from ``recheck``).

    ``requests`` is the table of already-submitted jobs (``job_name``); J8 is a left join on it.
    """
    if enable_auto_retrain and not retraining_batch:
        raise ValueError("a retraining source batch is required when automatic retraining is enabled")
    job = retraining_job_name(F.col("event_id"))
    frame = events.withColumn("job_name", F.when(_present(F.col("event_id")), job))
    if requests is not None:
        seen = requests.select("job_name").distinct().withColumn("__exists", F.lit(True))
        frame = frame.join(seen, "job_name", "left")
    else:
        frame = frame.withColumn("__exists", F.lit(None).cast("boolean"))
    exists = F.coalesce(F.col("__exists"), F.lit(False))
    action = (
        F.when(F.col("event_type") != STATUS_EVENT, F.lit(LOG_ONLY))
        .when(~F.col("confirmed_failure"), F.lit(IGNORE))
        .when(is_blank(F.col("breach_tag")), F.lit(LOG_FAILURE))
        .when(F.lit(not enable_auto_retrain), F.lit(LOG_ONLY))
        .when(exists, F.lit(HANDLED))
        .otherwise(F.lit(SUBMIT))
    )
    return frame.withColumn("action", action).withColumn(
        "retraining_job", F.when(F.col("action").isin(SUBMIT, HANDLED), F.col("job_name"))
    ).drop("__exists", "job_name")


def retraining_requests(decisions: DataFrame, retraining_batch: str) -> DataFrame:
    """One request per job name; the cutoff is the event's own time, as it wrote it."""
    return (
        decisions.where(F.col("action") == SUBMIT)
        .select(
            F.col("retraining_job").alias("job_name"),
            F.col("event_id").alias("source_event_id"),
            F.lit(retraining_batch).alias("source_batch_id"),
            F.col("event_time").alias("source_cutoff"),
            *[c for c in ("event_date",) if c in decisions.columns],
        )
        .dropDuplicates(["job_name"])
    )


def route_expired(deliveries: DataFrame, *, ttl: str = EVENT_TTL, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Dead-letter reason of a delivery (past its lifetime or attempts), else null."""
    return F.when(
        F.col("delivered_ts") > F.col("event_ts") + F.expr(f"INTERVAL {ttl}"), F.lit("expired")
    ).when(F.col("attempt") > max_attempts, F.lit("max_attempts"))


def daily_signals(events: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Per tumbling day starting 06:00: events, status events, breach events and share."""
    w = F.window(F.col(ts), "1 day", "1 day", "6 hours")
    breach = (F.col("event_type") == STATUS_EVENT) & ~is_blank(F.col("breach_tag"))
    return events.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == STATUS_EVENT).alias("status_events"),
        F.count_if(breach).alias("breach_events"),
    ).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "events",
        "status_events",
        "breach_events",
        F.round(F.col("breach_events") / F.col("events"), 12).alias("breach_share"),
    )


#: A delivery as the bus hands it over: the event's JSON text, when it was delivered, and the number of the attempt.
DELIVERY_SCHEMA = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("delivered_ts", T.TimestampNTZType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_CORRUPT = "corrupt_line"
_REQUESTS = "job_name string, source_event_id string, source_batch_id string, source_cutoff string, event_date date"
_HANDLED = "event_id string, event_ts timestamp_ntz, event_type string, run_id string, event_date date"
_DEAD = "event_id string, event_ts timestamp_ntz, delivered_ts timestamp_ntz, attempt int, reason string, body string, run string, batch long"


@dataclass
class EventReactor:
    """The streaming job of T1-T7 over a folder of delivered events, one JSON delivery a line.

    Each micro-batch is parsed whole. Lines that are no delivery, events that break the contract (no id and no time included),
    and deliveries past their lifetime go to the dead letters of that micro-batch; the others are deduplicated, rechecked and
    decided. Requests and handled events are partitioned by the event's date, and looked up on the batch's dates only.
    """

    spark: SparkSession
    source: str
    sink: str  # holds requests/, handled/ and dead_letters/
    status: DataFrame
    enable_auto_retrain: bool = True
    retraining_batch: str | None = None
    max_files_per_trigger: int | None = None  # bounds one micro-batch

    @property
    def requests_path(self) -> str:
        return f"{self.sink}/requests"

    @property
    def handled_path(self) -> str:
        return f"{self.sink}/handled"

    @property
    def dead_letter_path(self) -> str:
        return f"{self.sink}/dead_letters"

    def _table(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing written yet

    def _on(self, table: DataFrame, first, last) -> DataFrame:
        """The rows of a table partitioned by event date that lie on a batch's dates."""
        return table.where(F.col("event_date").between(F.lit(first), F.lit(last)))

    def routed(self, deliveries: DataFrame) -> DataFrame:
        """T1 + T7: every delivery with its parsed event, and the reason why it is a dead letter, or null."""
        parsed = parse_events(deliveries)
        events = parsed.withColumnsRenamed({"parsed_id": "event_id", "event_time_utc": "event_ts"})
        # A line that is no delivery has neither body nor time.
        reason = F.coalesce(F.when(F.col(_CORRUPT).isNotNull(), F.lit("invalid_delivery")), F.col("dead_letter"), route_expired(events))
        return events.withColumns({"dead_letter": reason, "event_date": F.to_date("event_ts")})

    def _batch(self, run: str):
        def react(deliveries: DataFrame, batch_id: int) -> None:
            routed = self.routed(deliveries).persist()
            try:
                self._bury(routed, run, batch_id)
                self._react(routed.where(F.col("dead_letter").isNull()).dropDuplicates(["event_id"]))
            finally:
                routed.unpersist()

        return react

    def _bury(self, routed: DataFrame, run: str, batch_id: int) -> None:
        """Dead letters of one micro-batch, in a folder of its own, which a replayed micro-batch writes again."""
        dead = routed.where(F.col("dead_letter").isNotNull()).select(
            "event_id", "event_ts", "delivered_ts", "attempt", F.col("dead_letter").alias("reason"),
            F.coalesce("body", _CORRUPT).alias("body"), F.lit(run).alias("run"), F.lit(batch_id).alias("batch"),
        )
        writer = dead.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch")
        writer.parquet(self.dead_letter_path)

    def _react(self, live: DataFrame) -> None:
        # Idempotent by content, so a replayed micro-batch adds nothing: requests are decided from the whole batch and
        # written first (anti-join on the job name), handled events second (anti-join on the event id). An event id always
        # carries the same event time, so only the batch's event dates can hold it.
        span = live.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
        if span["first"] is None:
            return
        requests = self._on(self._table(self.requests_path, _REQUESTS), *span)
        decisions = decide(
            recheck(live, self.status), requests, enable_auto_retrain=self.enable_auto_retrain, retraining_batch=self.retraining_batch
        )
        new = retraining_requests(decisions, self.retraining_batch or "").join(requests.select("job_name"), "job_name", "left_anti")
        # Rebalanced: few files a date, and a date with most of the events over several tasks.
        new.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(self.requests_path)
        handled = self._on(self._table(self.handled_path, _HANDLED), *span)
        fresh = live.join(handled.select("event_id"), "event_id", "left_anti")
        kept = fresh.select("event_id", "event_ts", "event_type", "run_id", "event_date").hint("rebalance", "event_date")
        kept.write.mode("append").partitionBy("event_date").parquet(self.handled_path)

    def run(self, checkpoint: str) -> None:
        """Process everything available now, then stop (``trigger(availableNow=True)``)."""
        schema = T.StructType([*DELIVERY_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
        reader = self.spark.readStream.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).option("timestampNTZFormat", TIME_FORMAT)
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        main = (
            reader.json(self.source)
            .writeStream.foreachBatch(self._batch(hashlib.sha256(checkpoint.encode()).hexdigest()[:12]))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        main.awaitTermination()

    def requests(self) -> DataFrame:
        return self._table(self.requests_path, _REQUESTS).drop("event_date")

    def handled(self) -> DataFrame:
        return self._table(self.handled_path, _HANDLED).drop("event_date")

    def dead_letters(self) -> DataFrame:
        """Each dead delivery once, however many runs met it."""
        return self._table(self.dead_letter_path, _DEAD).drop("run", "batch").distinct()


RUN_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_status", T.StringType()),
        T.StructField("breach_tag", T.StringType()),
    ]
)


def run_daily_signals(
    spark: SparkSession, source: str, sink: str, checkpoint: str, max_files_per_trigger: int | None = None
) -> None:
    """T8 as a stream: tumbling days from 06:00.

    Each micro-batch appends partial counts per window and source file to an append-only
    log; ``daily_signals_current`` adds them up, each file once. So neither a replay nor
    another cut into micro-batches changes the result. No watermark is set, so no late day
    is dropped.
    """
    reader = spark.readStream.schema(RUN_EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source).select("*", F.col("_metadata.file_path").alias("source_file"))
    w = F.window(F.col("event_ts").cast("timestamp"), "1 day", "1 day", "6 hours")
    breach = (F.col("event_type") == STATUS_EVENT) & ~is_blank(F.col("breach_tag"))

    def append(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(w.alias("w"), "source_file").agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event_type") == STATUS_EVENT).alias("status_events"),
            F.count_if(breach).alias("breach_events"),
        )
        counted.select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "events",
            "status_events",
            "breach_events",
            "source_file",
        ).write.mode("append").parquet(sink)

    q = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def daily_signals_current(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of every window in the signal log."""
    log = spark.read.schema(
        "window_start timestamp_ntz, window_end timestamp_ntz, events long, status_events long, breach_events long, source_file string"
    ).parquet(sink)
    once = log.dropDuplicates(["window_start", "window_end", "source_file"])
    totals = once.groupBy("window_start", "window_end").agg(
        *[F.sum(c).alias(c) for c in ("events", "status_events", "breach_events")]
    )
    return totals.select(
        "*", F.round(F.col("breach_events") / F.col("events"), 12).alias("breach_share")
    )
