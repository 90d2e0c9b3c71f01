"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.session import ensure_checkpoint_dir, scratch_path

# ASCII letters to lower case, every other ASCII character that is no letter or digit to a space.
# UTF-8 bytes from 0x80 on stay, so words may hold any other character.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; the driver's file server hands it out.

    Batches to them hold ``ROWS_PER_BATCH`` rows where the session says nothing else: whole texts are long rows.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(_BATCH_ROWS, str(ROWS_PER_BATCH))
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pitloom-package-"), "pitloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: compressed and read by column, unlike a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (ASCII letters, digits and any non-ASCII characters) as UTF-8 bytes."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def batches_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``limit`` bytes at most; one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    while start < len(sizes):
        total = np.cumsum(sizes[start:])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(start, n)
        start += n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers (multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
