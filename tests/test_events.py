"""Event reaction cases: submit once, stale status, disabled, no batch, parsing, stream replay."""

from __future__ import annotations

import datetime as dt
import json
import tempfile

import pytest

from pitloom.streaming import events as E

T0 = dt.datetime(2026, 7, 14, 12, 0)


def _monitor_event(event_id="event-123", tag=E.BREACH_PHRASE, etype=E.STATUS_EVENT):
    return json.dumps(
        {
            "id": event_id,
            "eventType": etype,
            "eventTime": "2026-07-14T12:00:00+00:00",
            "subject": "experiments/monitor/runs/run-42",
            "data": {"runId": "run-42", "runStatus": "Failed", "runTags": {E.BREACH_TAG: tag}},
        }
    )


def _events(spark, bodies):
    raw = spark.createDataFrame([(str(i), T0, b) for i, b in enumerate(bodies)], "event_id string, event_ts timestamp_ntz, body string")
    p = E.parse_events(raw).drop("event_id").withColumnRenamed("parsed_id", "event_id")
    return p


def _decide(spark, bodies, status="Failed", requests=None, enabled=True, batch="b1"):
    p = _events(spark, bodies).where("dead_letter IS NULL")
    st = spark.createDataFrame([("run-42", status)], "run_id string, status string")
    return E.decide(E.recheck(p, st), requests, enable_auto_retrain=enabled, retraining_batch=batch)


def test_confirmed_breach_submits(spark):
    d = _decide(spark, [_monitor_event()]).first()
    assert d["action"] == "SUBMIT_RETRAIN" and d["retraining_job"].startswith("retrain-")


def test_duplicate_delivery_is_already_handled(spark):
    first = _decide(spark, [_monitor_event()])
    reqs = E.retraining_requests(first, "b1")
    again = _decide(spark, [_monitor_event()], requests=reqs).first()
    assert again["action"] == "ALREADY_HANDLED"


def test_stale_status_is_ignored(spark):
    assert _decide(spark, [_monitor_event()], status="Completed").first()["action"] == "IGNORE"
    assert _decide(spark, [_monitor_event()], status="FAILED").first()["action"] == "SUBMIT_RETRAIN"


def test_disabled_logs_only(spark):
    assert _decide(spark, [_monitor_event()], enabled=False).first()["action"] == "LOG_ONLY"


def test_enabled_without_batch_is_an_error(spark):
    with pytest.raises(ValueError):
        _decide(spark, [_monitor_event()], batch=None)


def test_other_types_and_missing_breach(spark):
    rows = _decide(spark, [_monitor_event(etype="Other"), _monitor_event(tag="  ")]).orderBy("event_id").collect()
    assert [r["action"] for r in rows] == ["LOG_ONLY", "LOG_FAILURE"]


def test_parse_dead_letters_and_key_case(spark):
    bodies = [
        "not json",
        json.dumps({"eventType": "x", "data": {}}),
        json.dumps({"id": "1", "eventType": "x", "data": "s"}),
        json.dumps({"id": "2", "eventType": E.STATUS_EVENT, "data": {"runStatus": "Failed"}}),
        json.dumps({"ID": "3", "TYPE": "x", "data": {}, "EVENTTIME": "2026-07-14T12:00:00Z"}),
        json.dumps({"id": "4", "EventType": E.STATUS_EVENT, "data": {"RUNID": "r", "runstatus": "Failed"}, "eventTime": "2026-07-14T12:00:00Z"}),
    ]
    parsed = _events(spark, bodies).collect()
    by_body = {r["body"]: r["dead_letter"] for r in parsed}
    assert by_body["not json"] == "invalid_json"
    assert by_body[bodies[1]] == "missing_id"
    assert by_body[bodies[2]] == "data_not_object"
    assert by_body[bodies[3]] == "missing_run_id"
    assert by_body[bodies[4]] is None
    assert by_body[bodies[5]] is None
    assert len(parsed) == 6


def _body(event_id, at=T0, etype=E.STATUS_EVENT, tag=E.BREACH_PHRASE, **more):
    event = {
        "id": event_id, "eventType": etype, "eventTime": at.isoformat() + "+00:00" if isinstance(at, dt.datetime) else at,
        "data": {"runId": "run-42", "runStatus": "Failed", "runTags": {E.BREACH_TAG: tag}}, **more,
    }
    return json.dumps(event)


def _deliver(folder, *files):
    """Files of deliveries (body, delivered_ts, attempt), one line each; a plain text is written as it is."""
    import os

    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(files):
        with open(f"{folder}/f{i}.json", "w") as out:
            for line in lines:
                text = line if isinstance(line, str) else json.dumps(
                    {"body": line[0], "delivered_ts": line[1].isoformat(timespec="microseconds"), "attempt": line[2]}
                )
                out.write(text + "\n")


def _status(spark):
    return spark.createDataFrame([("run-42", "Failed")], "run_id string, status string")


def test_stream_is_idempotent_on_replay(spark):
    root = tempfile.mkdtemp(prefix="pitloom-events-")
    hours = lambda h: T0 + dt.timedelta(hours=h)
    _deliver(
        f"{root}/source",
        [(_body("e1"), T0, 1), (_body("e1"), hours(2), 2), (_body("e2"), hours(30), 1), (_body("e3", etype="Other", tag=""), T0, 1), (_body("e4"), hours(1), 13)],
    )
    r = E.EventReactor(spark, f"{root}/source", f"{root}/sink", _status(spark), True, "b1")
    r.run(f"{root}/ckpt1")
    r.run(f"{root}/ckpt2")  # everything delivered again
    assert [(x["source_event_id"], x["source_cutoff"]) for x in r.requests().collect()] == [("e1", "2026-07-14T12:00:00+00:00")]
    assert sorted(x["event_id"] for x in r.handled().collect()) == ["e1", "e3"]
    assert sorted((x["event_id"], x["reason"]) for x in r.dead_letters().collect()) == [("e2", "expired"), ("e4", "max_attempts")]


def test_malformed_deliveries_are_buried_and_stop_nothing(spark):
    """Broken lines, null ids and null, absent or senseless times, among good events, in several micro-batches."""
    root = tempfile.mkdtemp(prefix="pitloom-events-raw-")
    bad = {
        "invalid_json": "not json",
        "missing_id": _body(None),
        "missing_event_time": _body("t0", at=None),
        "invalid_event_time": _body("t1", at="2026-02-30T00:00:00Z"),
        "data_not_object": _body("t2", data=[1]),
        "missing_run_id": _body("t3", data={"runStatus": "Failed"}),
    }
    lines = [(b, T0, 1) for b in bad.values()]
    _deliver(f"{root}/source", [*lines[:3], (_body("g1", at="2026-07-14T14:00:00+02:00"), T0, 1), "{broken line"], [*lines[3:], (_body("g2", at="2026-07-14 12:00:00Z"), T0, 1)], lines[:1])
    r = E.EventReactor(spark, f"{root}/source", f"{root}/sink", _status(spark), True, "b1", max_files_per_trigger=1)
    r.run(f"{root}/ckpt")
    assert sorted((x["event_id"], x["event_ts"]) for x in r.handled().collect()) == [("g1", T0), ("g2", T0)]
    assert {x["source_event_id"]: x["source_cutoff"] for x in r.requests().collect()} == {"g1": "2026-07-14T14:00:00+02:00", "g2": "2026-07-14 12:00:00Z"}
    dead = r.dead_letters().collect()
    assert {x["reason"]: x["body"] for x in dead} == {**bad, "invalid_delivery": "{broken line"}
    assert len(dead) == len(bad) + 1


def test_request_lookup_is_pruned_by_date(spark):
    import io
    from contextlib import redirect_stdout

    root = tempfile.mkdtemp(prefix="pitloom-events-dates-")
    days = [T0 + dt.timedelta(days=d) for d in range(4)]
    _deliver(f"{root}/source", [(_body(f"e{i}", at=t), t, 1) for i, t in enumerate(days)])
    r = E.EventReactor(spark, f"{root}/source", f"{root}/sink", _status(spark), True, "b1")
    r.run(f"{root}/ckpt")
    looked_up = r._on(r._table(r.requests_path, E._REQUESTS), days[1].date(), days[2].date())
    out = io.StringIO()
    with redirect_stdout(out):
        looked_up.explain("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in out.getvalue() and looked_up.count() == 2


def test_required_fields_and_times(spark):
    bodies = [_body("a"), _body("b", at=None), _body("c", at=5), _body("d", at="soon"), _body("e", at="2026-07-14T12:00:00.5-05:30")]
    got = {r["parsed_id"]: (r["dead_letter"], r["event_time_utc"]) for r in E.parse_events(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert got["a"] == (None, T0) and got["e"] == (None, dt.datetime(2026, 7, 14, 17, 30, 0, 500000))
    assert [got[k][0] for k in "bcd"] == ["missing_event_time", "missing_event_time", "invalid_event_time"]


def test_daily_signal_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="pitloom-signals-")
    rows = [
        (str(i), T0 + dt.timedelta(hours=5 * i), E.STATUS_EVENT if i % 2 else "Other", "run-42", "Failed",
         E.BREACH_PHRASE if i % 3 else "")
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, E.RUN_EVENT_SCHEMA)
    df.write.parquet(f"{root}/source")
    E.run_daily_signals(spark, f"{root}/source", f"{root}/sink", f"{root}/ckpt")
    E.run_daily_signals(spark, f"{root}/source", f"{root}/sink", f"{root}/ckpt2")  # replayed from scratch
    got = sorted(E.daily_signals_current(spark, f"{root}/sink").collect())
    assert got == sorted(E.daily_signals(df).collect())


def test_required_fields_must_be_strings(spark):
    bodies = [
        json.dumps({"id": 5, "eventType": "x", "data": {}}),
        json.dumps({"id": "6", "eventType": 7, "data": {}}),
        json.dumps({"id": "8", "eventType": E.STATUS_EVENT, "data": {"runId": 9, "runStatus": "Failed"}}),
        json.dumps({"id": "10", "eventType": "x", "data": [1]}),
    ]
    by_body = {r["body"]: r["dead_letter"] for r in _events(spark, bodies).collect()}
    assert [by_body[b] for b in bodies] == ["missing_id", "missing_event_type", "missing_run_id", "data_not_object"]


def test_stream_over_many_micro_batches(spark):
    # One file per micro-batch: the dedupe and the idempotent sink span batches.
    root = tempfile.mkdtemp(prefix="pitloom-events-mb-")
    later = T0 + dt.timedelta(hours=1)
    _deliver(f"{root}/source", [(_body("e1"), T0, 1)], [(_body("e2", at=later), later, 1)], [(_body("e1"), T0 + dt.timedelta(hours=3), 2)])
    r = E.EventReactor(spark, f"{root}/source", f"{root}/sink", _status(spark), True, "b1", max_files_per_trigger=1)
    r.run(f"{root}/ckpt")
    assert sorted(x["source_event_id"] for x in r.requests().collect()) == ["e1", "e2"]
    assert sorted(x["event_id"] for x in r.handled().collect()) == ["e1", "e2"]


def test_backlog_in_any_order_loses_nothing(spark):
    # Days 10, 11, 1, 12, one file a micro-batch: the old day comes after newer ones.
    root = tempfile.mkdtemp(prefix="pitloom-events-late-")
    times = [T0 + dt.timedelta(days=d) for d in (10, 11, 1, 12)]
    _deliver(f"{root}/source", *[[(_body(f"e{i}", at=t), t + dt.timedelta(minutes=1), 1)] for i, t in enumerate(times)])
    r = E.EventReactor(spark, f"{root}/source", f"{root}/sink", _status(spark), True, "b1", max_files_per_trigger=1)
    r.run(f"{root}/ckpt")
    assert sorted(x["event_id"] for x in r.handled().collect()) == ["e0", "e1", "e2", "e3"]
    assert r.requests().count() == 4 and r.dead_letters().count() == 0
    rows = [(f"e{i}", t, E.STATUS_EVENT, "run-42", "Failed", E.BREACH_PHRASE) for i, t in enumerate(times)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], E.RUN_EVENT_SCHEMA).coalesce(1).write.parquet(f"{root}/events/part{i}")
    E.run_daily_signals(spark, f"{root}/events/*", f"{root}/signals", f"{root}/ckpt2", max_files_per_trigger=1)
    E.run_daily_signals(spark, f"{root}/events/*", f"{root}/signals", f"{root}/ckpt3")  # other batches, same files
    whole = E.daily_signals(spark.createDataFrame(rows, E.RUN_EVENT_SCHEMA))
    got = sorted(E.daily_signals_current(spark, f"{root}/signals").collect())
    assert len(got) == 4 and got == sorted(whole.collect())


def test_daily_counts_do_not_depend_on_the_micro_batches(spark):
    from pitloom.streaming import monitor as M

    root = tempfile.mkdtemp(prefix="pitloom-drift-")
    rows = [
        (T0 + dt.timedelta(hours=5 * i), None if i % 9 == 0 else float(i % 13), "ab"[i % 2], None if i % 4 == 0 else "ab"[i % 3 % 2]) for i in range(60)
    ]
    schema, edges = "ts timestamp_ntz, v double, prediction_class string, actual_class string", {"v": (2.0, 10.0)}
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(f"{root}/source")
    for k, files in enumerate((1, None)):
        M.run_daily_counts(spark, f"{root}/source", f"{root}/log", f"{root}/c{k}", schema=schema, ts="ts", features=edges, bins=4, max_files_per_trigger=files)
    counts = M.daily_counts(spark, f"{root}/log")
    want = {}
    for ts, v, p, a in rows:
        day = (ts - dt.timedelta(hours=6)).replace(hour=6, minute=0)
        bin_ = None if v is None else str(int(min(max((v - 2) // 2, 0), 3)))
        for key in [("class", "prediction_class", p), ("bin", "v", bin_), ("label", "prediction_class", None if a is None else "hit" if a == p else "miss")]:
            if key[2] is not None:
                want[day, *key] = want.get((day, *key), 0) + 1
    assert {(r.window_start, r.kind, r.subject, r.value): r.n for r in counts.collect()} == want
    reference = M.partial_counts(df, [], features=edges, bins=4)
    drift = {(r.window_start, r.signal): r.value for r in M.daily_drift(counts, reference.where("kind <> 'label'")).collect()}
    day = min(k[0] for k in want)
    hits, misses = want.get((day, "label", "prediction_class", "hit"), 0), want.get((day, "label", "prediction_class", "miss"), 0)
    assert drift[day, "delayed_accuracy"] == hits / (hits + misses)
    share = want[day, "class", "prediction_class", "a"] / sum(n for k, n in want.items() if k[0] == day and k[1] == "class")
    assert abs(drift[day, "total_variation"] - abs(share - 0.5)) < 1e-12
