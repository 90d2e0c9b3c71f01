"""Operator 13: near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components.

Each table hashes a vector to the signs of its products with some random hyperplanes; vectors whose codes agree in a table
share a bucket. The vectors of a bucket are compared with each other by their cosine in double precision, in blocks: a bucket
of any size is cut into blocks of about ``BLOCK`` vectors, and each pair of blocks is a piece of work of its own. A pair
counts in the first table whose bucket it shares, and in no other, so no list of pairs is ever needed to tell them apart:
a piece of work emits one row per vector (its links) and a spanning forest of the links it found. The forests lead to the
components by star contraction.

Equal vectors are one node with their number; a node's links count the copies on the other side.

The number of hyperplanes grows with the vectors, so that a bucket of unrelated vectors holds about one; the number of tables
follows from it, so that a pair at exactly the threshold is missed with a chance of ``MISS`` (one in a million), and a nearer
pair with less. ``tables=0`` compares every two vectors of a label, block by block, and misses nothing.

Defined results: only vectors of equal labels and equal lengths are compared. Vectors that are null, empty or zero, hold a null,
NaN or infinite component, or have a null label link with nothing: n_links 0, a component of their own. Repeated ids are rows
of their own; a null id is never a component's id unless all ids of the component are null. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import ship, stored
from pitloom.llm.dart_minhash import connected

SIMILARITY = 0.98
#: The chance to miss a pair at exactly the threshold.
MISS = 1e-6
#: Vectors of a block, and pairs compared at once.
BLOCK, PAIRS = 512, 1 << 16
SEED = 13

_KEY = ("label", "dim", "table", "code", "low", "high")


def tables_for(bits: int, similarity: float, miss: float = MISS) -> int:
    """Tables in which a pair of this similarity shares no bucket with a chance of at most ``miss``."""
    same = (1 - acos(similarity) / pi) ** bits
    return max(1, ceil(log(miss) / log(1 - same)))


def bits_for(vectors: int) -> int:
    """Hyperplanes of a table such that a bucket of so many unrelated vectors holds about one."""
    return min(30, max(4, ceil(log2(max(vectors, 1)))))


def _values(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((tables * bits, dim)).T


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): the signs of a table's products as an integer."""
    signs = scaled(vectors) @ planes(vectors.shape[1], bits, tables) >= 0
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
    return (signs.reshape(len(vectors), tables, bits) * weights).sum(axis=2).astype(np.int32)


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                step = max(1, (1 << 21) // (bits * tables + int(dim)))
                for start in range(0, len(some), step):
                    part = some.slice(start, step)
                    found = codes(_values(part.column("vector")), bits, tables)
                    offsets = pa.array(np.arange(len(part) + 1) * tables, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], names=["node", "codes"]
                    )

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each is linked to, over links (a, b)."""
    lead = np.arange(n)
    while True:
        low = np.minimum(lead[a], lead[b])
        after = lead.copy()
        np.minimum.at(after, lead[a], low)
        np.minimum.at(after, lead[b], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, lead):
            return lead
        lead = after


def _linked(rows: pa.RecordBatch, group: np.ndarray, similarity: float, every: bool) -> pa.RecordBatch:
    """(node, other, links) of whole pieces of work: ``group`` numbers the piece of each row, in ascending order."""
    vectors = scaled(_values(rows.column("vector")))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    node, copies = (np.asarray(rows.column(c)) for c in ("node", "copies"))
    block, low, high = (np.asarray(rows.column(c)) for c in ("block", "low", "high"))
    table = np.asarray(rows.column("table"))
    sign = None if every else rows.column("codes").flatten().to_numpy().reshape(len(rows), -1)
    ends = np.searchsorted(group, group, side="right")
    behind = ends - np.arange(len(rows)) - 1
    upto = np.cumsum(behind)
    found_a, found_b = [], []
    start = 0
    while start < len(rows):  # whole rows of pairs, as many as fit
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = behind[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        across = (low[a] == high[a]) | (block[a] != block[b])
        a, b = a[across], b[across]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= similarity * norms[a] * norms[b]
        a, b = a[near], b[near]
        if len(a) and not every:
            first = np.argmax(sign[a] == sign[b], axis=1)  # the first table they share
            a, b = a[first == table[a]], b[first == table[a]]
        found_a.append(a)
        found_b.append(b)
        start = stop
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    lead = components(len(rows), a, b)
    some = links > 0
    columns = [node[some], node[lead[some]], links[some]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "other", "links"])


def _compare(similarity: float, every: bool):
    """Pieces of work lie one after another; the last one of a batch may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 4 * BLOCK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = _numbers(whole)
            cut = int(np.searchsorted(group, group[-1]))  # the last piece may go on
            if cut:
                yield from _by_dim(whole.slice(0, cut), group[:cut], similarity, every)
            held = [whole.slice(cut)]
        if held and sum(map(len, held)):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from _by_dim(whole, _numbers(whole), similarity, every)

    return run


def _numbers(rows: pa.RecordBatch) -> np.ndarray:
    """0, 1, ... for the pieces of work of sorted rows."""
    piece = np.asarray(rows.column("piece"))
    new = np.zeros(len(rows), np.int64)
    new[1:] = piece[1:] != piece[:-1]
    for name in _KEY:
        column = rows.column(name)
        if pa.types.is_string(column.type):
            column = column.dictionary_encode().indices
        values = np.asarray(column)
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _by_dim(rows: pa.RecordBatch, group: np.ndarray, similarity: float, every: bool) -> Iterator[pa.RecordBatch]:
    dims = np.asarray(rows.column("dim"))
    for dim in np.unique(dims):
        at = dims == dim
        yield _linked(rows.filter(pa.array(at)), group[at], similarity, every)


def _pieces(members: DataFrame) -> DataFrame:
    """A row for each piece of work of a member: pairs of blocks (low, high) of its bucket, one of which holds it."""
    bucket = ["label", "dim", "table", "code"]
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = members.join(sizes, bucket).withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = blocks.withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("n_blocks")).cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return dealt.select(
        "node", *bucket, "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
    )


def links(nodes: DataFrame, similarity: float = SIMILARITY, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """(node, other, links): links found from ``node`` in one piece of work, and a node of the same component.

    ``nodes``: node (long), label, dim, vector, copies; each (label, vector) once.
    """
    spark = nodes.sparkSession
    ship(spark)
    every = tables == 0
    vectors = nodes.select("node", "dim", "vector", "copies")
    if every:
        members = nodes.select("node", "label", "dim", F.lit(0).alias("table"), F.lit(0).alias("code"))
    else:
        most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
        bits = bits or bits_for(most)
        tables = tables or tables_for(bits, similarity)
        hashed = vectors.mapInArrow(_hash(bits, tables), "node long, codes array<int>")
        signs = stored(hashed, "hyperplanes")
        members = signs.join(nodes.select("node", "label", "dim"), "node").select(
            "node", "label", "dim", F.posexplode("codes").alias("table", "code")
        )
        vectors = vectors.join(signs, "node")
    work = stored(_pieces(members), "hyperplanes")
    rows = work.join(vectors.drop("dim"), "node").withColumn("piece", F.xxhash64(*_KEY))
    if every:
        rows = rows.withColumn("codes", F.lit(None).cast("array<int>"))
    ordered = rows.repartition("piece").sortWithinPartitions("piece", *_KEY)
    return ordered.mapInArrow(_compare(similarity, every), "node long, other long, links long")


def near_duplicates(
    vectors: DataFrame, similarity: float = SIMILARITY, tables: int | None = None, bits: int | None = None,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    value = F.col(vector)
    fit = (
        F.col(label).isNotNull()
        & value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    # -0.0 is 0.0: equal vectors have equal bytes.
    plain = F.transform(value, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double"))
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.coalesce(fit, F.lit(False)).alias("fit"), value.alias("vector"),
        F.md5(F.concat_ws(",", F.lit(""), plain.cast("array<string>")).cast("binary")).alias("digest"),
    )
    distinct = (
        rows.filter("fit")
        .groupBy("label", "digest")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Numbered once and written: a second evaluation could number otherwise.
    nodes = stored(distinct, "hyperplanes")
    found = stored(links(nodes, similarity, tables, bits), "hyperplanes")
    ends = found.select(F.col("node").alias("a"), F.col("other").alias("b")).filter("a <> b")
    classes = connected(found.select("node").distinct(), ends)
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.drop("vector").join(classes, "node", "left").join(degree, "node", "left")
    placed = placed.withColumn("class", F.coalesce("class", "node"))
    lead = placed.groupBy("class").agg(F.min("first_id").alias("component_id"))
    known = placed.join(lead, "class").select(
        "label", "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    joined = rows.filter("fit").select("vec_id", "label", "digest").join(known, ["label", "digest"])
    own = rows.filter(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = joined.select("vec_id", "n_links", "component_id").unionAll(own)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label by brute force, and their closure.
ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 END),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached AS r JOIN l ON r.other = l.a),
lead AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lead LEFT JOIN degree USING (vec_id)
"""
