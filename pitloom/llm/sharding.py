"""Operator 5: contiguous, byte-balanced shards from global prefix sums.

Rows are ordered by ``order_by`` (then by content). The order is dealt into ranges, each range gives one
total, the running sum of those totals is every range's offset, and a running sum inside the range completes
the global prefix sum of bytes. Shard ``s`` takes the rows whose middle byte lies in the ``s``-th of
``n_shards`` equal parts of all bytes: shards are contiguous in the order and differ from the target by at
most one row at each cut. The text itself is never shuffled; only (order key, size, crc32) is.

Defined results: a null text has no bytes (size 1, crc32 0); null order keys come first; ties are ordered by
crc32 and size, and rows equal in all three are interchangeable; an empty table gives no rows; other columns
are ignored, whatever their names. One order key may hold any share of the rows: ranges are cut over
(key, crc32, row number), so equal keys are split too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitloom.llm.common import materialise, stored, text_or_empty


def assign_shards(docs: DataFrame, n_shards: int = 8, order_by: str = "doc_id") -> DataFrame:
    """One row per input row: ``order_by``, size, text_crc32, shard (int), slot (long, gapless from 0 in a shard)."""
    narrow = docs.select(
        F.col(order_by),
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    ).withColumn("row", F.monotonically_increasing_id())
    narrow = materialise(narrow)  # the text is read once, not again to find the ranges
    order = [F.col(order_by).asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("row")]
    # Written once: the ranges of a second evaluation could be cut elsewhere.
    ranged = materialise(
        narrow.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    )
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row per range: running sums over them need one task, whatever the table's size.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything.orderBy("range")).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(offsets, "range")
        .withColumn("start", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn(
            "shard",
            F.expr(f"cast(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div (2 * all_bytes)) as int)"),
        )
        .withColumn("position", F.col("rows_before") + F.col("nth") - 1)
    )
    # Shards are runs of positions, so rows per (range, shard) give each run's first position.
    runs = placed.groupBy("shard").agg(F.min("position").alias("first_position"))
    return placed.join(F.broadcast(runs), "shard").select(  # n_shards rows at most
        F.col(order_by), "size", "text_crc32", "shard", (F.col("position") - F.col("first_position")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, order_by: str = "doc_id") -> None:
    """Write every row once to ``path/shard=<n>/``, in slot order inside each file.

    Rows are placed by their number in a stored copy, so equal and null order keys keep their rows. Columns named ``shard`` or
    ``slot`` are kept as ``shard_of_row`` and ``slot_of_row``.
    """
    own = docs.withColumnsRenamed({c: f"{c}_of_row" for c in ("shard", "slot") if c in docs.columns})
    key = f"{order_by}_of_row" if order_by in ("shard", "slot") else order_by
    # Written once: a second evaluation could number otherwise.
    rows = stored(own.withColumn("_place", F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"))), "shards")
    places = assign_shards(rows, n_shards, "_place").select(F.col("_place.row").alias("_row"), "shard", "slot")
    (
        rows.join(places, F.col("_place.row") == F.col("_row"))
        .drop("_place", "_row")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
