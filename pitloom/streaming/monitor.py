"""T8 feeding A7-A10: daily drift, prediction drift and accuracy from mergeable partial counts.

A stream of scored rows (time, features, predicted class, and the actual class where it is known) is reduced, per micro-batch,
to counts per 06:00 day, source file and value: class counts, histogram bins on fixed edges, hits and misses. The counts go to
an append-only log. They add up in any order and in any cut into micro-batches, and each file counts once, so late days,
backlogs and replays change nothing. Signals are worked out from the added counts, against the counts of a reference.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.operators.drift import chi2_survival, xlog2

CLASS, BIN, LABEL = "class", "bin", "label"
HIT, MISS = "hit", "miss"
LOG = "window_start timestamp_ntz, kind string, subject string, value string, n long, source_file string"


def day_start(ts: Column) -> Column:
    """The start of the day, from 06:00 to 06:00, that holds a zone-less time."""
    return F.date_trunc("day", ts - F.expr("INTERVAL 6 HOURS")).cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")


def bin_number(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin of fixed edges that holds a value; what lies outside goes to the outer bins, null and NaN to none."""
    raw = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins))
    inner = F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0))
    return F.when(value.isNotNull() & ~F.isnan(value), inner)


def partial_counts(
    rows: DataFrame, by: list[str], *, features: Mapping[str, tuple[float, float]], bins: int = 10,
    prediction: str = "prediction_class", actual: str = "actual_class",
) -> DataFrame:
    """(by..., kind, subject, value, n) of scored rows. Null and NaN features, null predictions and unknown labels do not count."""

    def entry(kind: str, subject: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(subject).alias("subject"), value.cast("string").alias("value"))

    known = F.col(actual).isNotNull() & F.col(prediction).isNotNull()
    hit = F.when(known, F.when(F.col(actual) == F.col(prediction), F.lit(HIT)).otherwise(F.lit(MISS)))
    entries = [entry(CLASS, prediction, F.col(prediction)), entry(LABEL, prediction, hit)]
    for name, (low, high) in features.items():
        entries.append(entry(BIN, name, bin_number(F.col(name).cast("double"), low, high, bins)))
    long = rows.select(*by, F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return long.groupBy(*by, "kind", "subject", "value").agg(F.count(F.lit(1)).alias("n"))


def run_daily_counts(
    spark: SparkSession, source: str, log: str, checkpoint: str, *, schema: str, ts: str, features: Mapping[str, tuple[float, float]],
    bins: int = 10, max_files_per_trigger: int | None = None,
) -> None:
    """Append the counts of every scored file below ``source`` to the log; stop when all available files are done."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source).withColumns(
        {"window_start": day_start(F.col(ts)), "source_file": F.col("_metadata.file_path")}
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        counts = partial_counts(batch, ["window_start", "source_file"], features=features, bins=bins)
        counts.select("window_start", "kind", "subject", "value", "n", "source_file").write.mode("append").parquet(log)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(spark: SparkSession, log: str) -> DataFrame:
    """The log added up per day, each file once."""
    key = ["window_start", "kind", "subject", "value"]
    once = spark.read.schema(LOG).parquet(log).dropDuplicates([*key, "source_file"])
    return once.groupBy(*key).agg(F.sum("n").alias("n"))


def daily_drift(days: DataFrame, reference: DataFrame) -> DataFrame:
    """(window_start, signal, subject, value): A7 total variation, A8 Jensen-Shannon distance, A9 chi-squared statistic and
    p-value, A10 accuracy of each day.

    ``days``: ``daily_counts``; ``reference``: (kind, subject, value, n). Both hold a row per value, however many rows were
    scored. A day's values are met with the reference's by stacking: each (day, kind, subject) takes the reference rows.
    """
    key = ["window_start", "kind", "subject"]
    compared = days.where(F.col("kind") != LABEL)
    met = compared.select(*key).distinct().join(reference.withColumnRenamed("n", "p"), ["kind", "subject"])
    both = compared.withColumn("p", F.lit(0).cast("long")).withColumnRenamed("n", "q").unionByName(
        met.withColumn("q", F.lit(0).cast("long"))
    )
    cells = both.groupBy(*key, "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    sums = cells.groupBy(*key).agg(F.sum("p").alias("sum_p"), F.sum("q").alias("sum_q"))
    share = cells.join(sums, key).withColumns({"a": F.col("p") / F.col("sum_p"), "b": F.col("q") / F.col("sum_q")})
    middle = (F.col("a") + F.col("b")) / 2
    column = (F.col("p") + F.col("q")).cast("double")
    total = (F.col("sum_p") + F.col("sum_q")).cast("double")
    squares = F.col("p").cast("double") * F.col("p") / (F.col("sum_p") * column) + F.col("q").cast("double") * F.col("q") / (
        F.col("sum_q") * column
    )
    found = share.groupBy(*key).agg(
        (F.sum(F.abs(F.col("a") - F.col("b"))) * 0.5).alias("variation"),
        F.sqrt(F.greatest(F.sum(0.5 * xlog2(F.col("a"), middle) + 0.5 * xlog2(F.col("b"), middle)), F.lit(0.0))).alias("distance"),
        (F.max(total) * F.sum(squares) - F.max(total)).alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("df"),
    )
    p_value = chi2_survival(F.col("statistic"), F.col("df"))
    is_class = F.col("kind") == CLASS

    def signal(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("signal"), value.cast("double").alias("value")))

    signals = F.array_compact(
        F.array(
            signal("total_variation", is_class, F.col("variation")),
            signal("chi_squared", is_class, F.col("statistic")),
            signal("chi_squared_p_value", is_class & (F.col("df") > 0), p_value),
            signal("jensen_shannon_distance", ~is_class, F.col("distance")),
        )
    )
    drift = found.select("window_start", "subject", F.inline(signals)).select("window_start", "signal", "subject", "value")
    hits = F.sum(F.when(F.col("value") == HIT, F.col("n")).otherwise(0))
    accuracy = days.where(F.col("kind") == LABEL).groupBy("window_start", "subject").agg((hits / F.sum("n")).alias("accuracy"))
    labelled = accuracy.select("window_start", F.lit("delayed_accuracy").alias("signal"), "subject", F.col("accuracy").alias("value"))
    return drift.unionByName(labelled)
