"""Point-in-time (as-of) joins: J1 backward as-of, J2 coverage, J3 delayed retrieval.

Semantics (backward as-of, by key): every left row is kept; it is paired with the
right row of the same key whose time is the latest one at or before the left time
(exact matches allowed unless ``allow_exact=False``; of right rows at one instant the
greatest row wins); a pair older than the tolerance is dropped (the tolerance is
inclusive), leaving the right columns null. Left rows with a null key or time match nothing.

Plan (public DataFrame API only, no pairs are ever formed, no job runs while it is built):

* Instants. Both sides are folded to one row per (key, instant): the winning right row
  at that instant, and whether left rows ask there. Partial aggregates fold before the
  shuffle, so a burst of rows at one instant, on either side, is one row afterwards.
* Level A. Instants are cut into time slices. A running ``last(..., ignorenulls)`` window
  over ``(key, slice)`` finds the match inside the instant's own slice. A slice with more
  than ``max_slice_rows`` instants is cut into 2^k equal sub-slices.
* Level B. For matches in earlier slices, instants are reduced to one summary row per
  ``(key, slice)``; a running window per key over the summaries carries the latest
  earlier right row forward. A group holds one row per slice of a key.
* Labels. The left rows join the instants on (key, instant), which are unique there, so a
  hot instant is a skew join that Spark splits. Left rows without key or time are spread
  and join nothing.

Full left rows are shuffled once, by that last join. All else moves keys, times and folded
right rows; the shuffle of the instants is made once and reused.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.schemas import ENTITY, FEATURE_TS, LABEL_TS

_AT = "__pl_at"
_ROW = "__pl_row"
_ASKED = "__pl_asked"
_SLICE = "__pl_slice"
_MATCH = "__pl_match"
_PREV = "__pl_prev"
_TURN = "__pl_turn"
_TURNS = 1 << 12


def interval(text: str) -> Column:
    """An interval literal such as ``'30 days'`` or ``'1 hour'``."""
    return F.expr(f"INTERVAL {text}")


def _micros(col: Column, ntz: bool = True) -> Column:
    """Microseconds since the epoch, independent of the session time zone.

    Slice ids must be monotone in time: a zone-less timestamp is measured against the
    zone-less epoch (no daylight-saving gaps), a zoned one with ``unix_micros``.
    """
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.unix_micros(col)


_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}


def interval_micros(text: str) -> int:
    """Length of a day-time interval such as ``'30 days'`` in microseconds."""
    total = 0
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+?)s?\b", text.strip().lower())
    if not parts:
        raise ValueError(f"not a day-time interval: {text!r}")
    for amount, unit in parts:
        if unit not in _UNIT_MICROS:
            raise ValueError(f"unsupported interval unit {unit!r} in {text!r}")
        total += int(float(amount) * _UNIT_MICROS[unit])
    if total <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    return total


_FINE_BITS = 20  # sub-slices live on a common grid of 2^20 per slice


def _instants(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_at: Column, right_row: Column, row_type) -> DataFrame:
    """(keys, instant, right row or null, whether left rows ask): one row per key and instant."""
    asked = left.select(
        *keys, F.col(left_on).alias(_AT), F.lit(None).cast(row_type).alias(_ROW), F.lit(True).alias(_ASKED)
    )
    known = right.select(*keys, right_at.alias(_AT), right_row.alias(_ROW), F.lit(False).alias(_ASKED))
    both = asked.unionByName(known).where(_present([*keys, _AT]))
    return both.groupBy(*keys, _AT).agg(F.max(_ROW).alias(_ROW), F.max(_ASKED).alias(_ASKED))


def _present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _sliced(instants: DataFrame, keys: list[str], width: int, ntz: bool, max_slice_rows: int | None) -> DataFrame:
    """``instants`` with their slice; slices above the bound are cut into 2^k sub-slices.

    Sub-slice ids stay monotone in time within a key (slice * 2^20 + sub * 2^(20-k)), so level B orders them correctly.
    The table of slices above the bound has at most instants / ``max_slice_rows`` rows; Spark picks its join when it has
    counted them (none: the join goes).
    """
    at = _micros(F.col(_AT), ntz)
    cut = instants.withColumn(_SLICE, F.floor(at / F.lit(width)).cast("long"))
    if max_slice_rows is None:
        return cut
    hot = (
        cut.groupBy(*keys, _SLICE)
        .agg(F.count(F.lit(1)).alias("__pl_n"))
        .where(F.col("__pl_n") > max_slice_rows)
        .select(
            *keys,
            _SLICE,
            F.least(F.ceil(F.log2(F.col("__pl_n") / F.lit(float(max_slice_rows)))) + 1, F.lit(_FINE_BITS)).cast("int").alias("__pl_k"),
        )
    )
    k = F.coalesce(F.col("__pl_k"), F.lit(0))
    offset = at - F.col(_SLICE) * F.lit(width)
    sub = F.floor(offset * F.pow(F.lit(2.0), k) / F.lit(float(width))).cast("long")
    step = F.pow(F.lit(2.0), F.lit(_FINE_BITS) - k).cast("long")  # exact: at most 2^20
    refined = F.col(_SLICE) * F.lit(1 << _FINE_BITS).cast("long") + sub * step
    return cut.join(hot, [*keys, _SLICE], "left").withColumn(_SLICE, refined).drop("__pl_k")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str | Sequence[str] = ENTITY,
    left_on: str = LABEL_TS,
    right_on: str = FEATURE_TS,
    tolerance: str | None = None,
    delay: str | None = None,
    lookback: str | None = None,
    allow_exact: bool = True,
    slice_width: str = "1 day",
    max_slice_rows: int | None = 1_000_000,
) -> DataFrame:
    """Backward as-of join of ``left`` (labels) to ``right`` (features).

    ``max_slice_rows`` bounds a window group: a ``(key, slice)`` holding more instants is
    cut into 2^k equal sub-slices, k up to 20; ``None`` turns it off.

    ``delay`` shifts the right time to its availability time (``right_on + delay``),
    which is the time compared with ``left_on`` and with ``tolerance``;
    ``lookback`` bounds the raw right time (``right_on >= left_on - lookback``).
    Output: all left columns, then the right columns other than ``by``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    for name, frame, cols in (("left", left, [*keys, left_on]), ("right", right, [*keys, right_on])):
        missing = [c for c in cols if c not in frame.columns]
        if missing:
            raise ValueError(f"{name} side is missing columns: {', '.join(missing)}")
    right_cols = [c for c in right.columns if c not in keys]
    clash = sorted(set(right_cols) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides besides the key: {', '.join(clash)}")

    right_at = F.col(right_on) + interval(delay) if delay else F.col(right_on)
    right_row = F.struct(*[F.col(c) for c in right_cols])
    row_type = right.select(right_row.alias("r")).schema["r"].dataType
    instants = _instants(left, right, keys, left_on, right_at, right_row, row_type)
    ntz = isinstance(instants.schema[_AT].dataType, T.TimestampNTZType)
    sliced = _sliced(instants, keys, interval_micros(slice_width), ntz, max_slice_rows)

    # Level A: the latest right row inside the instant's own slice.
    group = Window.partitionBy(*keys, _SLICE).orderBy(_AT)
    frame_end = Window.currentRow if allow_exact else -1
    level_a = sliced.withColumn(
        _MATCH, F.last(_ROW, ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, frame_end))
    ).where(_ASKED)

    # Level B: the last right row of each slice, carried over the key's later slices.
    summary = sliced.groupBy(*keys, _SLICE).agg(
        F.max_by(_ROW, F.when(F.col(_ROW).isNotNull(), F.col(_AT))).alias(_ROW), F.max(_ASKED).alias(_ASKED)
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    level_b = (
        summary.withColumn(_PREV, F.last(_ROW, ignorenulls=True).over(earlier)).where(_ASKED).select(*keys, _SLICE, _PREV)
    )
    found = level_a.join(level_b, [*keys, _SLICE], "left").select(
        *[F.col(k).alias(f"__pl_by_{i}") for i, k in enumerate(keys)], _AT, F.coalesce(_MATCH, _PREV).alias(_MATCH)
    )

    # Labels: each left row takes what its instant found. Rows without a key or time match nothing: a turn of their own
    # spreads them over the tasks, where a null would put them all into one.
    turn = F.when(_present([*keys, left_on]), F.lit(0)).otherwise(F.monotonically_increasing_id() % _TURNS + 1)
    same = (F.col(left_on) == F.col(_AT)) & (F.col(_TURN) == F.col("__pl_on"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__pl_by_{i}"))
    match = F.col(_MATCH)
    ok = match.isNotNull()
    if tolerance:
        match_at = match[right_on] + interval(delay) if delay else match[right_on]
        ok = ok & (match_at >= F.col(left_on) - interval(tolerance))
    if lookback:
        ok = ok & (match[right_on] >= F.col(left_on) - interval(lookback))
    joined = left.withColumn(_TURN, turn).join(found.withColumn("__pl_on", F.lit(0).cast("long")), same, "left")
    return joined.select(*left.columns, *[F.when(ok, match[c]).alias(c) for c in right_cols])


def asof_coverage(spine: DataFrame, *, right_on: str = FEATURE_TS) -> DataFrame:
    """Labels without a point-in-time feature row, as a one-row rule table."""
    return spine.agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col(right_on).isNotNull()).alias("matched"),
        F.count_if(F.col(right_on).isNull()).alias("unmatched"),
    )


class FeatureSet:
    """A feature set definition consumed by point-in-time retrieval.

    ``source`` is a DataFrame (typically a Parquet snapshot) keyed by ``key`` with event
    time ``timestamp``; a row becomes visible ``source_delay`` after its time and is
    usable for ``temporal_join_lookback`` back from the label time.
    """

    def __init__(
        self,
        source: DataFrame,
        *,
        key: str = ENTITY,
        timestamp: str = FEATURE_TS,
        source_delay: str | None = "1 hour",
        temporal_join_lookback: str | None = "30 days",
        slice_width: str = "1 day",
    ):
        for c in (key, timestamp):
            if c not in source.columns:
                raise ValueError(f"feature set source is missing column {c!r}")
        self.source = source
        self.key = key
        self.timestamp = timestamp
        self.source_delay = source_delay
        self.temporal_join_lookback = temporal_join_lookback
        self.slice_width = slice_width

    def retrieve(self, labels: DataFrame, *, label_time: str = LABEL_TS) -> DataFrame:
        """Every label row with the feature row visible at its time, inside the lookback."""
        return asof_join(
            labels,
            self.source,
            by=self.key,
            left_on=label_time,
            right_on=self.timestamp,
            delay=self.source_delay,
            lookback=self.temporal_join_lookback,
            slice_width=self.slice_width,
        )
