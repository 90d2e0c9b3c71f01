"""Shards on disk: every row once, whatever its key and its column names."""

from __future__ import annotations

import tempfile

from pitloom.llm import sharding


def test_equal_and_null_keys_keep_their_rows(spark):
    rows = [(7, "x" * (i % 5), i, "s") for i in range(40)] + [(None, "null key", 40, None), (None, None, 41, "s"), (9, "a", 42, "t"), (9, "a", 42, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string").repartition(3)
    path = tempfile.mkdtemp(prefix="pitloom-shards-") + "/out"
    sharding.write_shards(docs, path, n_shards=4)
    found = spark.read.parquet(path).collect()
    assert sorted(((r.doc_id, r.text, r.shard_of_row, r.slot_of_row) for r in found), key=str) == sorted(rows, key=str)
    sizes = {}
    for r in found:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in sizes.values())
