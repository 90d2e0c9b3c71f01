"""Session helpers: one place for the SQL settings every operator relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session-level SQL settings the operators assume. They are runtime-settable,
# so they are applied to whatever session the caller hands in.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Duplicate JSON keys that differ only by case: the last one wins (event payloads).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Shuffled bytes that AQE lays together for one task. They are compressed: sorted and hashed by a join and the
# aggregates above it, they take up to thirty-five times as much memory.
TASK_BYTES = 10 << 20
# Parts of a shuffle before AQE lays them together. A shuffle of 10 GB is cut into parts of ``TASK_BYTES``.
SHUFFLE_PARTS = 1000
# Bytes of a file that one task scans. The rows it hands to a shuffle stay in its memory, as many as there is room for.
SCAN_BYTES = 32 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_PARTS = "spark.sql.shuffle.partitions"
_SCAN = "spark.sql.files.maxPartitionBytes"


def _bytes(text: str) -> int:
    """Bytes of a size as Spark's settings write it (``64MB``, ``16m``, ``67108864b``)."""
    amount, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(amount) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    """The settings above, and tasks of bounded size: a session's own smaller tasks or more parts stay."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if _bytes(spark.conf.get(_ADVISORY)) > TASK_BYTES:
        spark.conf.set(_ADVISORY, str(TASK_BYTES))
    if _bytes(spark.conf.get(_SCAN)) > SCAN_BYTES:
        spark.conf.set(_SCAN, str(SCAN_BYTES))
    parts = spark.conf.get(_INITIAL, None) or spark.conf.get(_PARTS)
    if int(parts) < SHUFFLE_PARTS:
        spark.conf.set(_INITIAL, str(SHUFFLE_PARTS))
    return spark


def local_session(
    cores: int | str = "*", partitions: int = 8, app: str = "pitloom", extra: dict[str, str] | None = None
) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("PITLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SQL_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (shared storage); only a local session may fall
    back to a fresh temporary folder, which is then registered as the checkpoint dir.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="pitloom-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared folder for one materialisation."""
    return f"{shared_dir(spark)}/pitloom/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` write into the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/rdd")
