"""Feature drift, prediction drift, delayed-label performance, verdicts.

The reference delegates these to a monitoring service and names only the signal,
the statistic and the threshold. Our definitions (parameters, not hidden choices):

* A8 Jensen-Shannon distance per numeric feature, base 2, over ``bins`` equal-width
  bins between the pooled minimum and maximum (the maximum falls in the last bin),
  no smoothing; null and NaN values are left out.
* A9 Pearson chi-squared test of independence of side x class; df = (sides-1)(classes-1).
* A10 accuracy of predictions against delayed labels (inner join on correlation id).
* A11 alerts: distance and variation alert above the threshold, p-value and accuracy below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JS_THRESHOLD = 0.25
P_VALUE_THRESHOLD = 0.05
ACCURACY_THRESHOLD = 0.65
TV_THRESHOLD = 0.50


def long_features(frame: DataFrame, side: str, features: Sequence[str]) -> DataFrame:
    """One row per (side, feature, value): all features in one pass by ``stack``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return frame.select(F.col(side).alias("side"), F.inline(pairs)).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def binned_shares(frame: DataFrame, side: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, bin, side, share) with bin edges shared by both sides."""
    values = long_features(frame, side, features)
    edges = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per feature: the edge table is bounded by the feature list.
    with_edges = values.join(F.broadcast(edges), "feature")
    width = F.col("hi") - F.col("lo")
    raw = F.floor((F.col("value") - F.col("lo")) / width * F.lit(bins))
    bucket = F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    counts = with_edges.groupBy("feature", "side", bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature", "side"))
    return counts.select("feature", "bin", "side", (F.col("n") / total).alias("share"))


def xlog2(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_distance(
    frame: DataFrame, side: str, features: Sequence[str], *, bins: int = 10, reference: str = "reference", current: str = "current"
) -> DataFrame:
    """(feature, js_distance)."""
    s = binned_shares(frame, side, features, bins)
    per_bin = s.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == reference, F.col("share")).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col("side") == current, F.col("share")).otherwise(0.0)).alias("q"),
    )
    m = (F.col("p") + F.col("q")) / 2
    return per_bin.groupBy("feature").agg(
        F.sqrt(F.greatest(F.sum(0.5 * xlog2(F.col("p"), m) + 0.5 * xlog2(F.col("q"), m)), F.lit(0.0))).alias(
            "js_distance"
        )
    )


def chi_squared(frame: DataFrame, side: str, cls: str) -> DataFrame:
    """(statistic, df) of the side x class contingency table.

    Over all cells, sum (o - e)^2 / e with e = row * col / n equals
    n * sum(o^2 / (row * col)) - n, and empty cells add nothing to the sum, so only the
    observed cells are needed. Row and column totals join back on the side and the
    class: no global window, no grid of absent cells.
    """
    obs = frame.groupBy(side, cls).agg(F.count(F.lit(1)).alias("o"))
    rows = obs.groupBy(side).agg(F.sum("o").alias("row"))
    cols = obs.groupBy(cls).agg(F.sum("o").alias("col"))
    cells = obs.join(rows, side).join(cols, cls)
    totals = cells.agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("row").cast("double") * F.col("col"))).alias("s"),
        F.sum("o").alias("n"),
        F.count_distinct(side).alias("sides"),
        F.count_distinct(cls).alias("classes"),
    )
    return totals.select(
        (F.col("n") * F.col("s") - F.col("n")).alias("statistic"),
        ((F.col("sides") - 1) * (F.col("classes") - 1)).cast("long").alias("df"),
    )


_SERIES, _FRACTION = 60, 100  # terms of the series and depth of the fraction: both below 1e-12


def _erfc_of_root(y: Column) -> Column:
    """erfc(sqrt(y)), the upper incomplete gamma Q(1/2, y): a series up to 2, a continued fraction beyond."""
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES)),
        F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * y / (n + 0.5)).alias("term"), (acc["total"] + acc["term"] * y / (n + 0.5)).alias("total")
        ),
        lambda acc: acc["total"],
    )
    below = F.aggregate(
        F.sequence(F.lit(_FRACTION), F.lit(1)), F.lit(0.0), lambda f, i: i * (i - 0.5) / (y + 2 * i + 0.5 - f)
    )
    scale = F.exp(-y) * F.sqrt(y) / F.sqrt(F.lit(pi))
    return F.when(y < 2, 1 - scale * term).otherwise(scale / (y + 0.5 - below))


def chi2_survival(stat: Column, df: Column) -> Column:
    """Upper tail of chi-squared, the regularised incomplete gamma Q(df/2, x/2), for any whole df; null below 1.

    Q(a + 1, y) = Q(a, y) + y^a e^-y / Gamma(a + 1), from Q(1, y) = e^-y for even df and Q(1/2, y) for odd. Each term is taken
    as an exponential of logs, so no factor leaves the range of a double, however large x and df are.
    """
    y = stat.cast("double") / 2
    log_y = F.log(F.greatest(y, F.lit(1e-300)))
    odd = df % 2 == 1
    start = F.when(odd, 0.5).otherwise(1.0)
    first = F.when(odd, 0.5 * log_y - y - F.lit(log(sqrt(pi) / 2))).otherwise(log_y - y)
    steps = F.floor((df - 1) / 2).cast("int")
    more = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.struct(first.alias("log_term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["log_term"] + log_y - F.log(start + j)).alias("log_term"), (acc["total"] + F.exp(acc["log_term"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    whole = F.when(odd, _erfc_of_root(y)).otherwise(F.exp(-y)) + F.when(steps > 0, more).otherwise(0.0)
    return F.when(df > 0, F.greatest(F.least(whole, F.lit(1.0)), F.lit(0.0)))


def chi_squared_p_value(frame: DataFrame, side: str, cls: str) -> DataFrame:
    """(statistic, df, p_value)."""
    chi = chi_squared(frame, side, cls)
    return chi.withColumn("p_value", chi2_survival(F.col("statistic"), F.col("df")))


def signal_rows(signals: Mapping[str, DataFrame]) -> DataFrame:
    """Union of ``(signal, subject, value)`` rows from each signal frame."""
    out = None
    for frame in signals.values():
        out = frame if out is None else out.unionByName(frame)
    return out


def verdict(signals: DataFrame, thresholds: Mapping[str, tuple[float, str]]) -> DataFrame:
    """One row per signal with ``alert``. ``thresholds``: signal -> (value, 'above'|'below').

    Thresholds are configuration (a handful of rows), applied as a literal map. A signal without a value or
    without a threshold alerts: what is not known to be well is not well.
    """
    limit = F.create_map(*[x for k, (v, _) in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    above = F.create_map(*[x for k, (_, d) in thresholds.items() for x in (F.lit(k), F.lit(d == "above"))])
    t = limit[F.col("signal")]
    return signals.select(
        "signal",
        "subject",
        "value",
        t.alias("threshold"),
        F.when(F.col("value").isNull() | F.isnan(F.col("value").cast("double")) | t.isNull(), True)
        .when(above[F.col("signal")], F.col("value") >= t)
        .otherwise(F.col("value") < t)
        .alias("alert"),
    )


DEFAULT_THRESHOLDS = {
    "jensen_shannon_distance": (JS_THRESHOLD, "above"),
    "total_variation": (TV_THRESHOLD, "above"),
    "chi_squared_p_value": (P_VALUE_THRESHOLD, "below"),
    "delayed_accuracy": (ACCURACY_THRESHOLD, "below"),
}
