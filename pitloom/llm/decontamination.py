"""Operator 4: benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Every window of ``n`` consecutive
benchmark words (an item of fewer words, but not none, is one window) goes into a hash set that each task holds.
Document windows are hashed by prefix sums over word ids, looked up in a bitmap and the sorted hashes, and every
hit is verified word by word. Words inside any occurrence of a window are hit.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text, so what a task holds stays bounded
for any benchmark; each block scans all documents, and the spans of all blocks are merged per row: for more than one
block ``find_hits`` stores the rows with a number each, as keys may be null or repeated.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows;
repeated items keep their own ids; a null item id never counts as an item but its windows still hit;
other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm.common import WORD_BYTES, batches_by_bytes, mix64, ship, stored, words_of

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: A document is contaminated if one word in so many is hit.
ONE_IN = 20
_BITS = 22
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

_ROW = "__pitloom_row"
HITS = "key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class WindowSet:
    """The windows of some items, in arrays: word ids, and by window length the sorted hashes of the distinct windows, the
    place of each among the words, and the items that hold it."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        seqs = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.words = np.concatenate([np.empty(0, np.int32), *seqs])
        self.names = [item for item, _ in items]
        self.codes = mix64(np.arange(len(self.ids) + 1, dtype=np.uint64) + np.uint64(1))
        counts = np.array([len(x) for x in seqs], np.int64)
        starts, sizes = np.cumsum(counts) - counts, np.minimum(counts, n)
        self.tables = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            which = np.flatnonzero(sizes == size)
            n_windows = counts[which] - size + 1
            first = np.cumsum(n_windows) - n_windows
            at = np.repeat(starts[which] - first, n_windows) + np.arange(n_windows.sum())
            owner = np.repeat(which, n_windows).astype(np.int32)
            hashes = np.zeros(len(at), np.uint64)
            for i, power in enumerate(_powers(_BASE, size)):
                with np.errstate(over="ignore"):
                    hashes += self.codes[self.words[at + i]] * power
            order = np.argsort(hashes, kind="stable")
            hashes, at, owner = hashes[order], at[order], owner[order]
            # Neighbours with the same words are one window; one hash may still stand for several.
            new = np.ones(len(at), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            for i in range(size):
                new[1:] |= self.words[at[1:] + i] != self.words[at[:-1] + i]
            group = np.cumsum(new) - 1
            held = np.unique(group * len(items) + owner)  # each item once a window, if it has a name
            held = held[np.array([x is not None for x in self.names])[held % len(items)]]
            upto = np.searchsorted(held // len(items), np.arange(group[-1] + 2))
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes >> np.uint64(64 - _BITS)] = True
            self.tables.append((size, hashes[new], at[new], (held % len(items)).astype(np.int32), upto, bitmap))

    def hits(self, seqs: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(first position, window length, items) of every occurrence in documents laid end to end."""
        out: list[tuple[int, int, list[str]]] = []
        if not len(seqs):
            return out
        up, down = _powers(_BASE, len(seqs)), _powers(_INVERSE, len(seqs))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes[seqs] * up, dtype=np.uint64)])
        known = np.concatenate([[0], np.cumsum(seqs > 0)])
        for size, hashes, places, held, upto, bitmap in self.tables:
            if size > len(seqs):
                continue
            with np.errstate(over="ignore"):
                h = (sums[size:] - sums[:-size]) * down[: len(seqs) - size + 1]
            at = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)] & (known[size:] - known[:-size] == size))
            lo = np.searchsorted(hashes, h[at], "left")
            hi = np.searchsorted(hashes, h[at], "right")
            inside = np.searchsorted(ends, at, "right")
            for p, a, b, d in zip(at.tolist(), lo.tolist(), hi.tolist(), inside.tolist(), strict=True):
                if p + size <= ends[d]:
                    for i in range(a, b):  # equal hashes: all but the same words are rejected
                        if np.array_equal(self.words[places[i] : places[i] + size], seqs[p : p + size]):
                            out.append((p, size, [self.names[j] for j in held[upto[i] : upto[i + 1]]]))
        return out


def _merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [{"first": a, "last": b} for a, b in merged]


_SETS: dict[tuple[str, int], WindowSet] = {}


def window_set(key: str, items: list[tuple[str | None, str | None]], n: int) -> WindowSet:
    """One set a process and block; batches and tasks that follow in the same worker share it, the last two are kept."""
    if (key, n) not in _SETS:
        while len(_SETS) > 1:
            del _SETS[next(iter(_SETS))]
        _SETS[(key, n)] = WindowSet(items, n)
    return _SETS[(key, n)]


def scan(
    spark: SparkSession, items: list[tuple[str | None, str | None]], n: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """The map over (key, text) batches that gives ``HITS`` rows for one block of items, which is broadcast: its size is
    bounded by the caller."""
    digest = hashlib.sha256(repr(items).encode("utf-8", "replace")).hexdigest()
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = window_set(digest, shared.value, n)
        get = windows.ids.get
        schema = pa.schema(
            [
                ("key", pa.int64()),
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            for part in batches_by_bytes(batch, "text", 8 << 20):
                texts = part.column("text").to_pylist()
                docs = [[get(w, 0) for w in words_of(t)] for t in texts]
                sizes = np.array([len(d) for d in docs], np.int64)
                ends = np.cumsum(sizes)
                seqs = np.fromiter((i for d in docs for i in d), np.int64, int(sizes.sum()))
                spans: dict[int, list[tuple[int, int]]] = {}
                items_of: dict[int, set[str]] = {}
                for p, size, owners in windows.hits(seqs, ends):
                    d = int(np.searchsorted(ends, p, "right"))
                    first = p - int(ends[d] - sizes[d])
                    spans.setdefault(d, []).append((first, first + size - 1))
                    items_of.setdefault(d, set()).update(owners)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(sizes),
                        pa.array([_merge(spans.get(d, [])) for d in range(len(docs))], schema.field("spans").type),
                        pa.array([sorted(items_of.get(d, ())) for d in range(len(docs))], schema.field("items").type),
                    ],
                    schema=schema,
                )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str | None, str | None]]]:
    """Items in blocks of bounded text, through the driver one at a time."""
    out: list[list[tuple[str | None, str | None]]] = [[]]
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        n = len((text or "").encode("utf-8", "replace"))
        if out[-1] and size + n > block_bytes:
            out.append([])
            size = 0
        out[-1].append((item, text))
        size += n
    return out


def _merged_spans(found: DataFrame) -> DataFrame:
    """Spans and items of several blocks, merged per row number in ``key``: the union of intervals as one fold."""
    grouped = found.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    fold = """
      aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (a, s) ->
        if(size(a) > 0 and s.first <= element_at(a, -1).last + 1,
           concat(slice(a, 1, size(a) - 1),
                  array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last)))),
           concat(a, array(s))))"""
    return grouped.withColumn("spans", F.expr(fold))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``HITS`` for ``docs`` (key, text): words, merged hit spans (word positions) and occurring items per key."""
    ship(docs.sparkSession)
    source = docs.select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    spark, blocks = docs.sparkSession, _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return source.mapInArrow(scan(spark, blocks[0], n), HITS)
    # Numbers are fixed once stored: every block sees the same.
    rows = stored(source.withColumn(_ROW, F.monotonically_increasing_id()), "decontamination-rows")
    numbered = rows.select(F.col(_ROW).alias("key"), "text")
    union = numbered.mapInArrow(scan(spark, blocks[0], n), HITS)
    for block in blocks[1:]:
        union = union.unionAll(numbered.mapInArrow(scan(spark, block, n), HITS))
    merged = _merged_spans(union).withColumnRenamed("key", _ROW)
    return rows.select("key", _ROW).join(merged, _ROW).select("key", "n_words", "spans", "items")


def verdict(hits: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Adds n_hit, n_items and contaminated (one word in ``one_in`` is hit, and one at least)."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)")
    return (
        hits.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood between two cut words goes with them."""
    raw = text.encode("utf-8")
    flat = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(flat), bool)
    for first, last in spans:
        keep[starts[first] : stops[last]] = False
    return flat[keep].tobytes().decode("utf-8")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with its own columns: contaminated documents gone, or (``action='spans'``) the hit words cut out, by one
    block of the benchmark after another (a cut may join words to a window that a later block holds)."""
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    ship(docs.sparkSession)
    blocks = _blocks(benchmark, block_bytes)
    out = docs
    types = {f.name: f.dataType for f in docs.schema.fields}
    for block in blocks:
        scanner = scan(docs.sparkSession, block, n)

        @F.pandas_udf("n_words long, spans array<struct<first:long,last:long>>")
        def hit(texts, scanner=scanner):
            import pandas as pd

            arrays = [pa.array(np.arange(len(texts))), pa.array(texts, pa.string(), from_pandas=True)]
            found = pa.Table.from_batches(scanner(iter([pa.RecordBatch.from_arrays(arrays, names=["key", "text"])])))
            return pd.DataFrame({"n_words": found["n_words"].to_pylist(), "spans": found["spans"].to_pylist()})

        hit = hit.asNondeterministic()  # once a row: a filter on it stays above it

        if action == "documents":
            out = _collected(out, hit)
        else:

            @F.pandas_udf("string")
            def without(texts, spans):
                import pandas as pd

                return pd.Series(
                    [
                        t if t is None or len(s) == 0 else _cut(t, [(x["first"], x["last"]) for x in s])
                        for t, s in zip(texts, spans, strict=True)
                    ],
                    dtype=object,
                )

            text = F.col("text").cast("string")
            out = out.withColumn("text", without(text, hit(text)["spans"]).cast(types["text"]))
    if action == "documents":
        spans = F.array_sort(F.flatten(F.transform(F.col(_FOUND), lambda x: x["spans"])))
        words = F.element_at(F.col(_FOUND), 1)["n_words"]
        covered = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(s["first"] - 1, a["upto"]))).alias("n"),
                F.greatest(a["upto"], s["last"]).alias("upto"),
            ),
        )["n"]
        out = out.filter(~((covered > 0) & (ONE_IN * covered >= words))).drop(_FOUND)
    return out


_FOUND = "__pitloom_hits"


def _collected(df: DataFrame, hit) -> DataFrame:
    """Adds a block's hits to the row's list of hits."""
    found = F.array(hit(F.col("text").cast("string")))
    return df.withColumn(_FOUND, F.concat(F.col(_FOUND), found) if _FOUND in df.columns else found)
