"""Quantity domain, label leak, correlation ids, rule tables and the PASS/BLOCK decision."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitloom.functions.quantity import ContractViolation, QuantityContract, label_actuals
from pitloom.operators import contracts as C

CONTRACT = QuantityContract("quantity-v1", 0, 3)


def test_quantity_domain(spark):
    # Accepted 0, 1.0, 3 -> "0", "1", "3"; refused -1, 1.5, inf, nan, 4; null is missing.
    rows = [(0.0,), (1.0,), (3.0,), (-1.0,), (1.5,), (float("inf"),), (float("nan"),), (4.0,), (None,), (-0.0,)]
    df = spark.createDataFrame(rows, "actual_quantity double")
    out = df.select(
        CONTRACT.encode(F.col("actual_quantity")).alias("c"), CONTRACT.violation(F.col("actual_quantity")).alias("v")
    ).collect()
    assert [r["c"] for r in out] == ["0", "1", "3", None, None, None, None, None, None, "0"]
    assert [r["v"] for r in out] == [
        None, None, None, "quantity_out_of_domain", "quantity_not_integral", "quantity_non_finite",
        "quantity_non_finite", "quantity_out_of_domain", "quantity_missing", None,
    ]


def test_quantity_type_refused_at_plan_time(spark):
    for ddl in ("actual_quantity boolean", "actual_quantity string", "actual_quantity decimal(10,2)"):
        df = spark.createDataFrame([], ddl)
        with pytest.raises(ContractViolation):
            label_actuals(df, CONTRACT)


def test_contract_parameters():
    with pytest.raises(ValueError):
        QuantityContract(" ", 0, 1)
    with pytest.raises(ValueError):
        QuantityContract("v", -1, 1)
    with pytest.raises(ValueError):
        QuantityContract("v", 2, 1)


def test_label_actuals_int_column(spark):
    df = spark.createDataFrame([("e1", 0), ("e2", 2)], "entity_id string, actual_quantity int")
    rows = label_actuals(df, CONTRACT).orderBy("entity_id").collect()
    assert [(r["quantity_class"], r["quantity_class_mapping_version"]) for r in rows] == [
        ("0", "quantity-v1"), ("2", "quantity-v1")
    ]


def test_mapping_mismatch(spark):
    df = spark.createDataFrame([("quantity-v1",), ("quantity-v2",), (None,)], "m string")
    assert [r[0] for r in df.select(CONTRACT.mapping_mismatch(F.col("m"))).collect()] == [False, True, True]


def test_label_leak_any_case():
    assert C.label_leak(["entity_id", "event_ts", "Actual_Class"]) == ["actual_class"]
    assert C.label_leak(["entity_id", "signal_a"]) == []
    with pytest.raises(ContractViolation):
        C.validate_scoring_population(type("F", (), {"columns": ["TARGET"]})())


@pytest.mark.parametrize(
    "ids, blank, dup",
    [([None, "a"], 1, 0), ([" ", "a"], 1, 0), (["\t", "a"], 1, 0), (["same", "same"], 0, 1), (["a", "b"], 0, 0)],
)
def test_correlation_ids(spark, ids, blank, dup):
    df = spark.createDataFrame([(i,) for i in ids], "correlation_id string")
    rows = {r["rule"]: r["violations"] for r in C.correlation_rules(df, "correlation_id", "scoring", 1).collect()}
    assert rows == {"blank_correlation_id": blank, "duplicate_correlation_id": dup}


def test_required_columns_of_all_populations_at_once(spark):
    from pyspark.sql import types as T

    want = T.StructType([T.StructField("kiln", T.StringType()), T.StructField("fired_at", T.TimestampNTZType()), T.StructField("heat", T.DoubleType())])
    good = spark.createDataFrame([], "heat int, fired_at timestamp, kiln string, glaze string")
    assert C.require_columns({"firings": (good, want)})["firings"].columns == ["kiln", "fired_at", "heat"]
    bad = spark.createDataFrame([], "kiln array<string>, fired_at double")
    with pytest.raises(ContractViolation) as error:
        C.require_columns({"firings": (good, want), "trials": (bad, want), "tests": (good.drop("heat"), want)})
    assert str(error.value).split("; ") == [
        "trials.kiln is array<string>, not string", "trials.fired_at is double, not timestamp_ntz", "trials.heat is absent", "tests.heat is absent",
    ]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, feature_ts timestamp_ntz, signal_a double, signal_b double")


def test_decision_first_failing_rule_blocks(spark):
    t = dt.datetime(2024, 1, 1)
    good = _frame(spark, [("a", t, 1.0, 2.0), ("b", t, 1.0, 2.0)])
    bad = _frame(spark, [("a", t, float("nan"), 2.0), ("a", t, 1.0, None)])
    rules = C.feature_frame_rules(good, "scoring", ["entity_id", "feature_ts"], ["signal_a", "signal_b"], 1).unionByName(
        C.feature_frame_rules(bad, "training", ["entity_id", "feature_ts"], ["signal_a", "signal_b"], 10)
    )
    d = C.decision(rules, mapping_version="quantity-v1").first()
    assert (d["decision"], d["reason"], d["violations"], d["failing_rules"]) == ("BLOCK", "training:null_signal_a", 1, 3)


def test_decision_pass_with_counts(spark):
    t = dt.datetime(2024, 1, 1)
    good = _frame(spark, [("a", t, 1.0, 2.0)])
    rules = C.feature_frame_rules(good, "scoring", ["entity_id", "feature_ts"], ["signal_a", "signal_b"], 1).unionByName(
        C.empty_population(good, "scoring", 0)
    )
    counts = good.agg(F.count(F.lit(1)).alias("feature_rows"))
    d = C.decision(rules, mapping_version="quantity-v1", counts=counts).first()
    assert (d["decision"], d["reason"], d["feature_rows"]) == ("PASS", None, 1)


def test_empty_population_blocks(spark):
    empty = _frame(spark, [])
    d = C.decision(C.empty_population(empty, "actuals", 3), mapping_version="v").first()
    assert (d["decision"], d["reason"]) == ("BLOCK", "actuals:empty")


def test_prediction_contract_requires_19_columns(spark):
    with pytest.raises(ContractViolation):
        C.prediction_contract_rules(spark.createDataFrame([], "prediction_id string"))
