"""Training support, classification metrics and the stratified hold-out.

All metrics are aggregates with map-side partial aggregation; per-class work is a
``groupBy(class)`` over one exploded row per prediction, so a dominant class costs
one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_support(frame: DataFrame, label: str, *, min_rows: int = 12, min_classes: int = 2) -> DataFrame:
    """A3: rows and distinct classes; ``ok`` when the hold-out is possible."""
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(label)).alias("classes")
    ).withColumn("ok", (F.col("rows") >= min_rows) & (F.col("classes") >= min_classes))


def _mean(value: Column, weight: Column | None) -> Column:
    """The mean over rows, or over as many rows as ``weight`` says each one stands for."""
    return F.avg(value) if weight is None else F.sum(value * F.when(value.isNotNull(), weight)) / F.sum(F.when(value.isNotNull(), weight))


def accuracy(frame: DataFrame, prediction: str, actual: str, weight: Column | None = None) -> Column:
    """A4: share of rows whose predicted class equals the actual one."""
    return _mean((F.col(prediction) == F.col(actual)).cast("double"), weight)


def confusion(frame: DataFrame, prediction: str, actual: str, weight: Column | None = None) -> DataFrame:
    """A5: per class over the union of actual and predicted classes: tp, fp, fn, support.

    ``weight`` is the number of rows that each one stands for.
    """
    hit = F.col(prediction) == F.col(actual)
    one, none = (F.lit(1), F.lit(0)) if weight is None else (weight, F.lit(0).cast("long"))
    entries = F.when(
        hit, F.array(F.struct(F.col(actual).alias("cls"), one.alias("tp"), none.alias("fp"), none.alias("fn")))
    ).otherwise(
        F.array(
            F.struct(F.col(prediction).alias("cls"), none.alias("tp"), one.alias("fp"), none.alias("fn")),
            F.struct(F.col(actual).alias("cls"), none.alias("tp"), none.alias("fp"), one.alias("fn")),
        )
    )
    return (
        frame.select(F.inline(entries))
        .groupBy("cls")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .select(
            F.col("cls").alias("class"),
            "tp",
            "fp",
            "fn",
            (F.col("tp") + F.col("fn")).alias("support"),
            (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        )
    )


def macro_f1(conf: DataFrame) -> DataFrame:
    """A5: unweighted mean of per-class F1 (not Spark's weighted ``f1``)."""
    return conf.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def log_loss(p_true: Column, eps: float = 1e-15, weight: Column | None = None) -> Column:
    """Mean negative log of the probability given to the true class, clipped to [eps, 1-eps]."""
    return _mean(-F.log(F.greatest(F.least(p_true, F.lit(1 - eps)), F.lit(eps))), weight)


def shares(frame: DataFrame, side: str, cls: str) -> DataFrame:
    """Class shares per side: (cls, side, share); the count table is (#sides x #classes)."""
    counts = frame.groupBy(side, cls).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(side))
    return counts.select(cls, side, (F.col("n") / total).alias("share"))


def total_variation(frame: DataFrame, side: str, cls: str, reference: str = "reference", current: str = "current") -> DataFrame:
    """0.5 * sum |p - q| over the union of classes (U3); missing classes have share 0."""
    s = shares(frame, side, cls)
    per_class = s.groupBy(cls).agg(
        F.sum(F.when(F.col(side) == reference, F.col("share")).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col(side) == current, F.col("share")).otherwise(0.0)).alias("q"),
    )
    return per_class.agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("total_variation"))


def hash_fraction(keys: Sequence[Column], seed: int) -> Column:
    """Approximate split key in [0, 1): the first 32 bits of SHA-256(seed, keys)."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_split(frame: DataFrame, keys: Sequence[str], *, seed: int, fraction: float = 0.25) -> DataFrame:
    """W2, approximate form: ``validation`` when the key's hash fraction is below ``fraction``.

    Map-only (no shuffle, no window); per-class shares are close to ``fraction`` for large
    classes but not exact. The exact form is ``stratified_split``.
    """
    frac = hash_fraction([F.col(k) for k in keys], seed)
    return frame.withColumn("split", F.when(frac < F.lit(fraction), F.lit("validation")).otherwise(F.lit("train")))


def stratified_split(
    frame: DataFrame, label: str, keys: Sequence[str], *, seed: int, fraction_num: int = 1, fraction_den: int = 4, few: bool = False
) -> DataFrame:
    """Exact stratified hold-out; adds ``split`` = 'validation' | 'train'.

    Rows of a class are ordered by SHA-256(seed, keys); the first ceil(n * num / den) of
    them go to validation (none of a class of one row); rows without a label are one class.

    Skew-safe, in two phases. Rows are counted by a 16-bit hash prefix; running counts per class (at most 65,536 rows a
    class) name, for each class, the one bucket that holds the cut and how many of its rows are taken: a table of one row a
    class. Buckets below it go to validation whole, those above it to training. Only the rows of the cut's bucket, about
    1/65,536 of a class, are ranked by a window.

    ``few``: the caller knows that the classes are few. Their table is broadcast then, and the rows are not shuffled by class.
    """
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    bucket = F.conv(F.substring("__h", 1, 4), 16, 10).cast("int")
    hashed = frame.withColumn("__h", h).withColumn("__b", bucket)
    counts = hashed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    per_class = Window.partitionBy(label)
    before = F.coalesce(F.sum("__n").over(per_class.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(per_class)
    # A class of one row is for training: a validation class without training rows says nothing.
    wanted = F.when(total > 1, F.floor((total * fraction_num + (fraction_den - 1)) / fraction_den)).otherwise(0).cast("long")
    cuts = (
        counts.select(F.col(label).alias("__label"), "__b", "__n", before.alias("__before"), wanted.alias("__k"))
        # The first bucket that the cut does not pass: it gives k - before of its rows, fewer than it holds.
        .where((F.col("__before") <= F.col("__k")) & (F.col("__before") + F.col("__n") > F.col("__k")))
        .select("__label", F.col("__b").alias("__cut"), (F.col("__k") - F.col("__before")).alias("__take"))
    )
    placed = hashed.join(F.broadcast(cuts) if few else cuts, hashed[label].eqNullSafe(F.col("__label")), "left")
    inside = (F.col("__b") == F.col("__cut")) & (F.col("__take") > 0)
    nth = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h"))
    ranked = placed.where(inside).withColumn("__nth", nth).withColumn("__val", F.col("__nth") <= F.col("__take"))
    whole = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("__val", F.coalesce(F.col("__b") < F.col("__cut"), F.lit(True)))
    split = F.when(F.col("__val"), F.lit("validation")).otherwise(F.lit("train")).alias("split")
    return whole.select(*frame.columns, split).unionAll(ranked.select(*frame.columns, split))
