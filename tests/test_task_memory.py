"""Tasks of a large shuffle stay small however the session cuts its shuffles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pitloom.session import SCAN_BYTES, SHUFFLE_PARTS, TASK_BYTES, configure

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTS = "spark.sql.shuffle.partitions"
SCAN = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.set(PARTS, "2")
    own.conf.unset(INITIAL)
    return own


def test_a_task_takes_a_bounded_part_of_a_shuffle(session):
    configure(session)
    rows = 1_600_000  # some 100 MB of texts that do not compress
    digest = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(2)])
    dealt = session.range(rows).select("id", digest.alias("d")).groupBy("id").agg(F.max("d").alias("d"))
    parts = dealt.select(F.spark_partition_id().alias("part"), "d").groupBy("part").agg(F.sum(F.length("d")).alias("n"))
    sizes = [r["n"] for r in parts.collect()]
    assert sum(sizes) == rows * 128
    assert max(sizes) < 3 * TASK_BYTES  # hex digits: two of them take a byte when compressed


def test_a_session_keeps_smaller_tasks_and_more_parts(session):
    session.conf.set(ADVISORY, "8m")
    session.conf.set(PARTS, "5000")
    configure(session)
    assert session.conf.get(ADVISORY) == "8m"
    assert session.conf.get(INITIAL, None) is None
    session.conf.set(ADVISORY, "1g")
    session.conf.set(INITIAL, "7")
    configure(session)
    assert session.conf.get(ADVISORY) == str(TASK_BYTES)
    assert session.conf.get(INITIAL) == str(SHUFFLE_PARTS)


def test_a_task_of_a_join_takes_10_mb(session):
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")  # as if there were few cores
    configure(session)
    rows = 800_000
    digest = F.sha2(F.col("id").cast("string"), 256)  # LZ4 leaves such texts as long as they are
    left = session.range(rows).select(digest.alias("k"))
    right = session.range(rows).select(digest.alias("k"), F.lit(1).alias("n"))
    joined = left.hint("merge").join(right, "k").groupBy(F.spark_partition_id().alias("part")).agg(F.sum(2 * F.length("k")).alias("n"))
    sizes = [r["n"] for r in joined.collect()]
    assert sum(sizes) == rows * 128
    assert max(sizes) < 13 << 20


def test_a_task_scans_a_bounded_part_of_a_file(session, tmp_path):
    session.conf.set("spark.sql.files.minPartitionNum", "1")  # as a table much larger than the cluster has cores for
    digest = F.sha2(F.col("id").cast("string"), 256)
    rows = session.range(0, 1_000_000, 1, 1).select("id", digest.alias("d"))
    rows.write.option("parquet.block.size", 4 << 20).option("compression", "none").parquet(str(tmp_path / "t"))
    configure(session)
    table = session.read.parquet(str(tmp_path / "t"))
    sizes = [r["n"] for r in table.groupBy(F.spark_partition_id()).agg(F.sum(F.length("d") + 8).alias("n")).collect()]
    assert sum(sizes) == 1_000_000 * 72
    assert max(sizes) < 40 << 20


def test_a_session_keeps_smaller_scans(session):
    session.conf.set(SCAN, "16m")
    configure(session)
    assert session.conf.get(SCAN) == "16m"
    session.conf.set(SCAN, "1g")
    configure(session)
    assert session.conf.get(SCAN) == str(SCAN_BYTES)
