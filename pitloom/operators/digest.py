"""Order-independent digest of a snapshot (schema and rows).

Each row is hashed (SHA-256 over its rendered text); the 256-bit hash is cut into
four 60-bit words that are summed as ``decimal(38,0)`` over all rows, a multiset
hash: independent of row order and partitioning, sensitive to duplicates, and
computed with partial aggregation only (no sort, no group that grows with data).
``2^38`` rows could not overflow the sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.functions.identity import kinds, row_hash

WORDS = 4
WORD_HEX = 15  # 60 bits per word
MODULUS = 2**60


def schema_text(frame: DataFrame, columns: Sequence[str] | None = None) -> str:
    cols = columns or frame.columns
    return ",".join(f"{c}:{frame.schema[c].dataType.simpleString()}" for c in cols)


def snapshot_digest(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``schema`` and ``snapshot_sha256``."""
    cols = list(columns or frame.columns)
    h = row_hash(kinds(frame.schema, cols) if columns is None else [k for k in kinds(frame.schema) if k[0] in cols])
    hashed = frame.select(h.alias("h"))
    words = [
        F.conv(F.substring(F.col("h"), 1 + i * WORD_HEX, WORD_HEX), 16, 10).cast("decimal(38,0)").alias(f"w{i}")
        for i in range(WORDS)
    ]
    sums = hashed.select(*words).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(WORDS)]
    )
    schema = schema_text(frame, cols)
    folded = [F.coalesce(F.pmod(F.col(f"s{i}"), F.lit(MODULUS).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(WORDS)]
    return sums.select(
        F.col("rows"),
        F.lit(schema).alias("schema"),
        F.sha2(F.concat_ws("|", F.lit(schema), F.col("rows").cast("string"), *folded), 256).alias("snapshot_sha256"),
    )
