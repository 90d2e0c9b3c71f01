"""Snapshot digest invariance, exact stratified split against a window, metric formulas."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitloom.operators import drift as D
from pitloom.operators import metrics as M
from pitloom.operators.digest import snapshot_digest


def test_digest_ignores_order_and_partitioning(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}", i * 0.5) for i in range(500)], "id int, k string, v double")
    a = snapshot_digest(df).first()["snapshot_sha256"]
    b = snapshot_digest(df.repartition(13, "k").orderBy(F.rand(3))).first()["snapshot_sha256"]
    assert a == b


def test_digest_sees_duplicates_and_changes(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(100)], "id int, v double")
    base = snapshot_digest(df).first()["snapshot_sha256"]
    assert snapshot_digest(df.unionByName(df.limit(1))).first()["snapshot_sha256"] != base
    assert snapshot_digest(df.withColumn("v", F.when(F.col("id") == 5, 0.0).otherwise(F.col("v")))).first()["snapshot_sha256"] != base


@pytest.mark.parametrize("seed", [17, 5])
def test_stratified_split_is_exact(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"id{i}", rnd.choice(["big"] * 20 + ["mid"] * 5 + ["one", "two"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, cls string")
    got = {r["key"]: r["split"] for r in M.stratified_split(df, "cls", ["key"], seed=seed).collect()}
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("key")), 256)
    w = Window.partitionBy("cls").orderBy(h)
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cls")))
    want = {
        r["key"]: ("validation" if r["rn"] <= (r["n"] + 3) // 4 else "train") for r in ref.collect()
    }
    assert got == want


def test_confusion_macro_f1(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(rows, "pred string, act string")
    conf = {r["class"]: r for r in M.confusion(df, "pred", "act").collect()}
    assert (conf["b"]["tp"], conf["b"]["fp"], conf["b"]["fn"]) == (1, 0, 2)
    assert set(conf) == {"a", "b", "c"}  # union of predicted and actual classes
    f1 = M.macro_f1(M.confusion(df, "pred", "act")).first()["macro_f1"]
    assert math.isclose(f1, (2 / 3 + 0.5 + 0.0) / 3)


def test_total_variation_and_js(spark):
    rows = [("reference", "x", 1.0)] * 50 + [("reference", "y", 2.0)] * 50 + [("current", "x", 1.0)] * 100
    df = spark.createDataFrame(rows, "side string, cls string, v double")
    assert math.isclose(M.total_variation(df, "side", "cls").first()[0], 0.5)
    js = D.js_distance(df, "side", ["v"], bins=2).first()["js_distance"]
    p, q = [0.5, 0.5], [1.0, 0.0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y) if a > 0)
    assert math.isclose(js, math.sqrt(0.5 * kl(p, m) + 0.5 * kl(q, m)))


def _by_ml(df):
    """Spark ML's test of the same table."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    idx = StringIndexer(inputCols=["side", "cls"], outputCols=["s", "c"]).fit(df).transform(df)
    vec = VectorAssembler(inputCols=["c"], outputCol="v").transform(idx)
    return ChiSquareTest.test(vec, "v", "s", flatten=True).first()


@pytest.mark.parametrize("classes", [2, 3, 4, 6, 8, 9])
def test_chi_squared_p_value_equals_ml(spark, classes):
    rows = [("r" if (i * 7) % 13 < 6 else "c", f"k{(i * i) % 101 % classes}") for i in range(400)]
    df = spark.createDataFrame(rows, "side string, cls string")
    r, ml = D.chi_squared_p_value(df, "side", "cls").first(), _by_ml(df)
    assert r["df"] == classes - 1 and math.isclose(r["statistic"], ml["statistic"])
    assert math.isclose(r["p_value"], ml["pValue"], rel_tol=1e-9, abs_tol=1e-12)


def test_chi_squared_tail_of_any_df(spark):
    # Closed forms: erfc for df 1, and the recurrence from it for df 3 and 5.
    for x in (0.0, 1e-9, 0.3, 1.0, 3.84, 3.99, 4.01, 10.0, 60.0, 700.0):
        y = x / 2
        one = math.erfc(math.sqrt(y))
        three = one + 2 * math.sqrt(y / math.pi) * math.exp(-y)
        five = three + 4 / 3 * y * math.sqrt(y / math.pi) * math.exp(-y)
        got = spark.range(1).select(*[D.chi2_survival(F.lit(x), F.lit(d)).alias(f"p{d}") for d in (0, 1, 3, 5)]).first()
        assert got.p0 is None
        for have, want in zip(got[1:], (one, three, five), strict=True):
            assert math.isclose(have, want, rel_tol=1e-9, abs_tol=1e-14), (x, have, want)


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "p double")
    v = df.agg(M.log_loss(F.col("p"))).first()[0]
    assert math.isclose(v, (-math.log(1e-15) - math.log(1 - 1e-15)) / 2)


def test_row_hash_accepts_extreme_doubles(spark):
    from pitloom.functions.identity import kinds, row_hash

    df = spark.createDataFrame(
        [(1, float("nan")), (2, float("inf")), (3, -1e300), (4, 0.1), (5, None)], "id int, v double"
    )
    hashes = [r[0] for r in df.select(row_hash(kinds(df.schema))).collect()]
    assert len(set(hashes)) == 5
    assert snapshot_digest(df).first()["rows"] == 5


def test_hash_split_is_map_only_and_close(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    out = M.hash_split(df, ["key"], seed=17)
    share = out.where(F.col("split") == "validation").count() / 20000
    assert abs(share - 0.25) < 0.02
    assert sorted(out.collect()) == sorted(M.hash_split(df.repartition(7), ["key"], seed=17).collect())
