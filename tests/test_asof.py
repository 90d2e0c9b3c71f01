"""J1/J3 against a brute-force as-of on random frames: ties, nulls, tolerance edges, far slices."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from pitloom.operators.asof import asof_join, interval_micros

BASE = dt.datetime(2024, 1, 1)
L_SCHEMA = T.StructType(
    [T.StructField("entity_id", T.StringType()), T.StructField("event_ts", T.TimestampNTZType()), T.StructField("lid", T.LongType())]
)
R_SCHEMA = T.StructType(
    [T.StructField("entity_id", T.StringType()), T.StructField("feature_ts", T.TimestampNTZType()), T.StructField("v", T.DoubleType())]
)


def _frames(seed: int, n_left=300, n_right=200):
    rnd = random.Random(seed)
    ents = ["a", "b", "c", "hot", None]
    right = {}
    for _ in range(n_right):
        e = rnd.choice(ents[:-1] + ["hot"] * 3)
        ts = BASE + dt.timedelta(hours=rnd.randint(0, 24 * 90))
        right[(e, ts)] = float(rnd.randint(0, 10**6))  # unique grain
    right_rows = [(e, ts, v) for (e, ts), v in right.items()]
    right_rows += [("a", None, 1.0), (None, BASE, 2.0)]
    left_rows = []
    keys = list(right)
    for i in range(n_left):
        if i % 5 == 0 and keys:  # exact time of a feature row
            e, ts = rnd.choice(keys)
        elif i % 7 == 0 and keys:  # exactly at the tolerance edge of a feature row
            e, ts = rnd.choice(keys)
            ts = ts + dt.timedelta(days=3)
        else:
            e = rnd.choice(ents + ["hot"] * 3)
            ts = BASE + dt.timedelta(hours=rnd.randint(-48, 24 * 95))
        if i % 31 == 0:
            ts = None
        left_rows.append((e, ts, i))
    return left_rows, right_rows


def _brute(left_rows, right_rows, tolerance=None, delay=dt.timedelta(0), lookback=None, allow_exact=True):
    out = {}
    for e, ts, lid in left_rows:
        best = None
        if e is not None and ts is not None:
            for re_, rts, v in right_rows:
                if re_ != e or rts is None:
                    continue
                key = rts + delay
                if key < ts or (allow_exact and key == ts):
                    if best is None or key > best[0] + delay:
                        best = (rts, v)
            if best is not None:
                key = best[0] + delay
                if tolerance is not None and key < ts - tolerance:
                    best = None
                elif lookback is not None and best[0] < ts - lookback:
                    best = None
        out[lid] = best
    return out


def _run(spark, left_rows, right_rows, **kw):
    left = spark.createDataFrame(left_rows, L_SCHEMA)
    right = spark.createDataFrame(right_rows, R_SCHEMA)
    got = asof_join(left, right, **kw).collect()
    return {r["lid"]: (None if r["feature_ts"] is None else (r["feature_ts"], r["v"])) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_width", ["1 day", "1 hour", "30 days"])
def test_backward_no_tolerance(spark, seed, slice_width):
    l, r = _frames(seed)
    assert _run(spark, l, r, slice_width=slice_width) == _brute(l, r)


@pytest.mark.parametrize("seed", [3, 4])
def test_tolerance_inclusive(spark, seed):
    l, r = _frames(seed)
    tol = dt.timedelta(days=3)
    got = _run(spark, l, r, tolerance="3 days", slice_width="6 hours")
    assert got == _brute(l, r, tolerance=tol)


def test_strictly_before(spark):
    l, r = _frames(5)
    assert _run(spark, l, r, allow_exact=False) == _brute(l, r, allow_exact=False)


def test_delay_and_lookback(spark):
    l, r = _frames(6)
    got = _run(spark, l, r, delay="1 hour", lookback="2 days")
    assert got == _brute(l, r, delay=dt.timedelta(hours=1), lookback=dt.timedelta(days=2))


def test_every_left_row_kept(spark):
    l, r = _frames(7)
    left = spark.createDataFrame(l, L_SCHEMA)
    right = spark.createDataFrame(r, R_SCHEMA)
    assert asof_join(left, right).count() == len(l)


def test_interval_parser():
    assert interval_micros("30 days") == 30 * 86_400_000_000
    assert interval_micros("1 hour") == 3_600_000_000
    with pytest.raises(ValueError):
        interval_micros("1 month")


@pytest.mark.parametrize("seed", [8, 9])
def test_hot_slices_are_refined_exactly(spark, seed):
    # A tiny bound forces most (key, slice) groups to be cut into sub-slices.
    l, r = _frames(seed)
    got = _run(spark, l, r, tolerance="3 days", slice_width="30 days", max_slice_rows=3)
    assert got == _brute(l, r, tolerance=dt.timedelta(days=3))
    assert _run(spark, l, r, max_slice_rows=1) == _brute(l, r)


def test_slices_do_not_depend_on_the_session_zone(spark):
    l, r = _frames(10)
    want = _brute(l, r, tolerance=dt.timedelta(days=3))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _run(spark, l, r, tolerance="3 days", slice_width="1 hour") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_hot_instant_is_one_row_of_its_window(spark):
    """One key, one instant, 3,000 rows on both sides, bound 100: no window group above the bound, results exact."""
    from pitloom.operators import asof as A

    at = BASE + dt.timedelta(hours=1)
    l = [("hot", at, i) for i in range(3000)] + [("hot", at + dt.timedelta(seconds=1), 3000)]
    r = [("hot", at, float(i)) for i in range(3000)]
    got = _run(spark, l, r, max_slice_rows=100)
    assert set(got.values()) == {(at, 2999.0)} and len(got) == 3001
    left, right = spark.createDataFrame(l, L_SCHEMA), spark.createDataFrame(r, R_SCHEMA)
    row = A.F.struct("feature_ts", "v")
    instants = A._instants(left, right, ["entity_id"], "event_ts", A.F.col("feature_ts"), row, right.select(row.alias("r")).schema["r"].dataType)
    sizes = A._sliced(instants, ["entity_id"], interval_micros("1 day"), True, 100).groupBy("entity_id", A._SLICE).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100 and instants.count() == 2


def test_many_instants_stay_below_the_bound(spark):
    from pitloom.operators import asof as A

    l = [("hot", BASE + dt.timedelta(seconds=7 * i), i) for i in range(4000)]
    r = [("hot", BASE + dt.timedelta(seconds=14 * i), float(i)) for i in range(2000)]
    got = _run(spark, l, r, max_slice_rows=100)
    assert got == {i: (BASE + dt.timedelta(seconds=14 * (i // 2)), float(i // 2)) for i in range(4000)}
    left, right = spark.createDataFrame(l, L_SCHEMA), spark.createDataFrame(r, R_SCHEMA)
    row = A.F.struct("feature_ts", "v")
    instants = A._instants(left, right, ["entity_id"], "event_ts", A.F.col("feature_ts"), row, right.select(row.alias("r")).schema["r"].dataType)
    sizes = A._sliced(instants, ["entity_id"], interval_micros("1 day"), True, 100).groupBy("entity_id", A._SLICE).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100


def test_empty_sides(spark):
    l, r = _frames(11)
    assert set(_run(spark, l, []).values()) == {None}
    assert _run(spark, [], r) == {}
