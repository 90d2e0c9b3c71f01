"""A forest of many rows: rows counted by bins and class, with the draws, trees and metrics of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.operators import scoring as S
from pitloom.operators.metrics import accuracy, confusion, log_loss


def _rows(n=6000, seed=3):
    rnd = np.random.default_rng(seed)
    a, b = rnd.normal(0, 1, n) * 10 ** rnd.integers(0, 6, n), rnd.integers(0, 3, n).astype(float)
    noisy = rnd.random(n) < 0.1
    cls = np.where(noisy, "z", np.where(a > 50, "x", np.where(b > 1, "y", "z")))
    return [(f"k{i}", float(a[i]), float(b[i]), str(cls[i])) for i in range(n)]


SCHEMA = "key string, a double, b double, cls string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


def _train(table, **more):
    return S.train_classifier(table, features=["a", "b"], label="cls", key=["key"], num_trees=12, max_depth=5, **more)


def test_counted_cells_train_as_the_rows_do(table):
    rows, cells = _train(table), _train(table, row_trees=0)
    assert "Bucketizer" in str(cells.model.stages[0]) and "Bucketizer" not in str(rows.model.stages[0])
    assert cells.model.stages[2].getNumTrees == 12
    a, b = rows.metrics.first(), cells.metrics.first()
    assert (a["validation_rows"], a["train_rows"]) == (b["validation_rows"], b["train_rows"]) == (1501, 4499)
    assert all(abs(a[m] - b[m]) < 0.05 for m in ("accuracy", "macro_f1", "log_loss"))
    assert rows.holdout.exceptAll(cells.holdout).count() == 0 and cells.holdout.count() == 1501


def test_metrics_of_cells_are_those_of_the_rows(table):
    result = _train(table, row_trees=0)
    names = result.model.stages[-1].getLabels()
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("cls")).cast("int")
    from pyspark.ml.functions import vector_to_array

    scored = result.model.transform(result.holdout).select(
        "cls", "prediction_class", F.element_at(vector_to_array("__probability"), place).alias("p")
    )
    plain = scored.agg(accuracy(scored, "prediction_class", "cls").alias("a"), log_loss(F.col("p")).alias("l"), F.count("*").alias("n")).first()
    f1 = confusion(scored, "prediction_class", "cls").agg(F.avg("f1")).first()[0]
    got = result.metrics.first()
    assert got["validation_rows"] == plain["n"]
    assert [got["accuracy"], got["log_loss"], got["macro_f1"]] == pytest.approx([plain["a"], plain["l"], f1], rel=1e-12)


def test_the_model_depends_on_the_rows_alone(table):
    again = table.orderBy(F.rand(5)).repartition(7)
    models = [_train(t, row_trees=0).model.stages[2].toDebugString.split("\n", 1)[1] for t in (table, again)]
    assert models[0] == models[1]


def test_few_rows_and_many_cells_keep_the_rows(table, monkeypatch):
    def none(*_, **__):
        raise AssertionError("counted")

    monkeypatch.setattr(S, "_cell_forest", none)
    _train(table)
    monkeypatch.setattr(S, "CELLS", 100)
    _train(table, row_trees=0)


def test_cuts_are_even_shares_of_all_rows(spark):
    rnd = np.random.default_rng(1)
    heavy = np.concatenate([np.exp(rnd.normal(0, 9, 20_000)), np.full(4_000, 7.0), -np.exp(rnd.normal(0, 9, 8_000))])
    few = rnd.choice([1.0, 2.0, 4.5], len(heavy))
    table = spark.createDataFrame([(float(x), float(y), 3.0) for x, y in zip(heavy, few)], "x double, y double, z double").repartition(5)
    x, y, z = S.cut_points(table, ["x", "y", "z"])
    assert y == [1.5, 3.25] and z == []
    share = np.searchsorted(np.sort(heavy), x, side="right") / len(heavy)
    want = np.arange(1, 32) / 32
    near = np.abs(share[:, None] - want[None, :]).min(axis=0)
    tied = (want > np.mean(heavy < 7)) & (want < np.mean(heavy <= 7))  # no cut goes through a value
    assert near[~tied].max() < 1 / 256
    assert x == sorted(set(x)) and not set(x) & set(heavy[heavy != 7])


def test_bins_read_as_a_tree_does(spark):
    frame = spark.createDataFrame([(1.0,), (1.5,), (1.5000000000000002,), (9.0,)], "x double")
    got = [r["__bin_0"] for r in S._bucketizer(["x"], [[1.5, 3.0]]).transform(frame).collect()]
    assert got == [0.0, 0.0, 1.0, 2.0]


def test_infinite_values_keep_the_rows_and_nulls_fail(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0)], "x double, y double")
    assert S.cut_points(frame, ["x", "y"]) is None
    with pytest.raises(ValueError, match="null or not a number"):
        S.cut_points(spark.createDataFrame([(1.0,), (None,)], "x double"), ["x"])


def test_neighbouring_doubles_are_told_apart(spark):
    x = 1.0
    frame = spark.createDataFrame([(x,), (float(np.nextafter(x, 2)),)], "x double")
    assert S.cut_points(frame, ["x"]) == [[x]]


def test_a_cell_is_drawn_as_its_rows_are():
    n, trees = 400, 5000
    cell = np.random.default_rng([17, 1, 2]).poisson(n, trees)
    rows = np.random.default_rng(5).poisson(1, (trees, n)).sum(axis=1)
    assert abs(cell.mean() - rows.mean()) < 2 and abs(cell.std() - rows.std()) < 1


def test_the_lifecycle_scores_with_counted_cells(spark, monkeypatch):
    from functools import partial

    from pitloom.plans import lifecycle as L
    from test_lifecycle import _config, _separable

    monkeypatch.setattr(L, "train_classifier", partial(S.train_classifier, row_trees=0))
    ev = {r["stage"]: r for r in L.run_lifecycle(spark, _separable(spark), _config()).collect()}
    assert ev["train"]["rows"] == 102  # a quarter of 134, 133 and 133 rows, rounded up
    assert ev["register_select"]["reason"] == "PROMOTE"
    assert ev["invoke_batch"]["rows"] == ev["publish"]["rows"] == ev["prepare_monitor_data"]["rows"] == 400
