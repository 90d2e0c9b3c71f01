"""Unknown is never well: gate, alerts and p-values beyond the ordinary; splits keep every row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pitloom.operators import drift as D
from pitloom.operators import gate as G
from pitloom.operators import metrics as M


def test_gate_needs_rules(spark):
    none = spark.createDataFrame([], "segment string, champion_version string, champion_mapping string")
    with pytest.raises(ValueError, match="without rules"):
        G.gate_reasons(none, none, none, none, [])


def test_split_keeps_rows_without_a_label_and_trains_on_lone_rows(spark):
    df = spark.range(101).select(
        F.col("id").cast("string").alias("key"), F.when(F.col("id") >= 10, F.when(F.col("id") == 100, "rare").otherwise("x")).alias("label")
    )
    out = M.stratified_split(df, "label", ["key"], seed=3).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in out} == {
        (None, "validation"): 3, (None, "train"): 7, ("x", "validation"): 23, ("x", "train"): 67, ("rare", "train"): 1
    }


@pytest.mark.parametrize(("x", "df", "want"), [(2000.0, 2000, 0.4958), (0.0, 2, 1.0), (0.0, 8, 1.0), (9.488, 4, 0.05), (5000.0, 2000, 0.0)])
def test_p_value_stays_finite(spark, x, df, want):
    got = spark.range(1).select(D.chi2_survival(F.lit(x), F.lit(df)).alias("p")).first().p
    assert abs(got - want) < 2e-3


def test_unknown_signals_alert(spark):
    rows = [("a", "s", 0.5), ("a", "s", None), ("a", "s", float("nan")), ("other", "s", 0.0), ("a", "s", 0.1)]
    signals = spark.createDataFrame(rows, "signal string, subject string, value double")
    assert [r.alert for r in D.verdict(signals, {"a": (0.3, "above")}).collect()] == [True, True, True, True, False]
