"""Identities: stable, sensitive to every field, byte-equal to Python's canonical JSON for ASCII."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pitloom.functions.identity import (
    candidate_material,
    candidate_version,
    double_text,
    iso_utc,
    json_string,
    kinds,
    prediction_id,
    retraining_job_name,
    row_hash,
    utc_ntz,
    utc_text,
    version_slug,
)

FIELDS = ("source_batch_id", "entity_id", "correlation_id", "prediction_ts", "model_name", "model_version", "mapping_version")


def _py_pid(**kw):
    canonical = json.dumps(kw, sort_keys=True, separators=(",", ":")).encode()
    return "pred_" + hashlib.sha256(canonical).hexdigest()[:32]


def _pid(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FIELDS))
    return [r[0] for r in df.select(prediction_id(**{f: F.col(f) for f in FIELDS})).collect()]


def test_prediction_id_matches_python_json(spark):
    row = ("batch-1", "e1", "c1", "2026-01-01T00:00:00+00:00", "model", "2", "quantity-v1")
    assert _pid(spark, [row]) == [_py_pid(**dict(zip(FIELDS, row)))]


def test_prediction_id_stable_and_sensitive(spark):
    a = ("b", "e", "c", "t", "m", "1", "v")
    ids = _pid(spark, [a, a, a[:5] + ("2",) + a[6:], a[:2] + ("c2",) + a[3:]])
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_empty_identity_field_fails(spark):
    with pytest.raises(Exception, match="identity fields must not be empty"):
        _pid(spark, [("b", "", "c", "t", "m", "1", "v")])


def test_retraining_job_name(spark):
    df = spark.createDataFrame([("event-123",)], "id string")
    name = df.select(retraining_job_name(F.col("id"))).first()[0]
    expected = "retrain-" + hashlib.sha256(json.dumps({"event_grid_event_id": "event-123"}, separators=(",", ":")).encode()).hexdigest()[:24]
    assert name == expected


def test_iso_utc_like_python(spark):
    ts = [dt.datetime(2026, 1, 1, 0, 0), dt.datetime(2026, 1, 1, 0, 0, 0, 500)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    got = [r[0] for r in df.select(iso_utc(F.col("t"))).collect()]
    assert got == [t.replace(tzinfo=dt.UTC).isoformat() for t in ts]


def test_version_slug(spark):
    df = spark.createDataFrame([("1",), ("UNITED STATES",), ("a" * 40,)], "v string")
    got = [r[0] for r in df.select(version_slug(F.col("v"))).collect()]
    assert got == ["v-1", "v-united-states", ("v-" + "a" * 40)[:32]]


def test_json_strings_equal_python(spark):
    texts = ["", "plain", 'q"b\\s', "tab\tnl\nret\r\b\f", "\x00\x1f\x7f", "é漢", "🧑\u200d🚀", "a\u2028b", "end\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_string(F.col("t"))).collect()] == [json.dumps(t) for t in texts]
    row = ("größe", "e1", "订单-7", "2026-01-01T00:00:00+00:00", "модель", "2", "v🧑")
    assert _pid(spark, [row]) == [_py_pid(**dict(zip(FIELDS, row)))]


def _exact(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    m, e = math.frexp(abs(x))
    return f"{'-' if x < 0 else ''}{int(m * 2**53)}p{e - 53}"


def test_double_text_is_exact(spark):
    rng = random.Random(8)
    some = [0.0, -0.0, 1e-7, 4e-7, 0.1, -0.1, 1.0, 2.0, 0.5, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    some += [float("nan"), float("inf"), float("-inf"), 2.0**-1022, 3 * 5e-324]
    some += [math.ldexp(rng.random() + 0.5, rng.randint(-1070, 1020)) * rng.choice([1, -1]) for _ in range(500)]
    some += [math.nextafter(2.0**k, d) for k in range(-60, 60, 7) for d in (0.0, math.inf)]
    df = spark.createDataFrame([(x,) for x in some], "x double").coalesce(1)
    assert [r[0] for r in df.select(double_text(F.col("x"))).collect()] == [_exact(x) for x in some]


def test_row_hash_tells_tiny_values_and_decimals_apart(spark):
    from decimal import Decimal

    rows = [(1e-7, Decimal("0.1")), (4e-7, Decimal("0.1")), (1e-7, Decimal("0.100000000000000001")), (None, None)]
    df = spark.createDataFrame(rows, "d double, n decimal(38,18)")
    assert len({r[0] for r in df.select(row_hash(kinds(df.schema))).collect()}) == 4


def test_instants_with_offsets_in_any_session_zone(spark):
    texts = ["2000-01-01T02:00:00+02:00", "2000-01-01 00:00:00", "1999-12-31T19:00:00.000001-05:00", "2000-01-01T00:00:00Z", "2000-06-30", "2000-01-01T02:00:00+0200", None]
    want = ["2000-01-01T00:00:00", "2000-01-01T00:00:00", "2000-01-01T00:00:00.000001", "2000-01-01T00:00:00", "2000-06-30T00:00:00", "2000-01-01T00:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    zoned = spark.createDataFrame([(dt.datetime(2000, 7, 1, 12, tzinfo=dt.UTC),), (dt.datetime(1931, 5, 1, 0, 0, 0, 7, tzinfo=dt.UTC),)], "t timestamp").coalesce(1)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in df.select(utc_ntz(F.col("t"), df.schema["t"].dataType)).collect()]
            assert [None if g is None else g.isoformat() for g in got] == want
            got = [r[0] for r in zoned.select(iso_utc(utc_ntz(F.col("t"), zoned.schema["t"].dataType))).collect()]
            assert got == ["2000-07-01T12:00:00+00:00", "1931-05-01T00:00:00.000007+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc_text("2000-06-30T02:00:00+02:00") == "2000-06-30 00:00:00" == utc_text("2000-06-30 00:00:00")


def test_candidate_version_depends_on_each_input(spark):
    base = dict(
        snapshot_sha256=F.lit("s"), source_cutoff="2000-01-01", mapping_version="v1", random_seed=17, model_implementation="m",
        training_features_query="q1", actuals_query="q2", entity_column="e", feature_timestamp_column="t", correlation_column="c",
        feature_columns=["a", "b"],
    )
    other = [{}, {"random_seed": 18}, {"source_cutoff": "2000-01-02"}, {"mapping_version": "v2"}, {"feature_columns": ["b", "a"]}, {"actuals_query": "q3"}]
    df = spark.range(1).select(*[candidate_version(candidate_material(**{**base, **o})) for o in other])
    got = list(df.first())
    assert len(set(got)) == len(other)
    material = {
        "actuals_query_sha256": hashlib.sha256(b"q2").hexdigest(), "correlation_column": "c", "entity_column": "e", "feature_columns": ["a", "b"],
        "feature_timestamp_column": "t", "mapping_version": "v1", "model_implementation": "m", "random_seed": 17, "snapshot_sha256": "s",
        "source_cutoff": "2000-01-01", "training_features_query_sha256": hashlib.sha256(b"q1").hexdigest(),
    }
    assert got[0] == hashlib.sha256(json.dumps(material, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
