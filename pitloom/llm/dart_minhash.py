"""Operator 1: near-duplicate groups by DartMinHash signatures and banded joining.

A document is the weighted set of its 5-word shingles, weighted by how often they occur. Every element throws darts:
for each unit cell of its (weight, rank) plane a hash says how many darts the cell holds (Poisson, mean 1), and for
each dart its weight, its rank and the signature coordinate it falls on. A set sees the darts below its elements'
weights; per coordinate it keeps the dart of least rank. Ranks are only looked at up to a bound that leaves about
``DARTS`` darts per document, so a signature costs little more than the shingles themselves; coordinates still empty
are filled by doubling the bound. Two sets agree at a coordinate with the chance of their weighted Jaccard similarity.

Documents that agree on a whole band of coordinates are candidates, and every link that counts is checked exactly on
the texts: weighted Jaccard similarity of the shingles of ``SIMILARITY`` or more. 32 bands of 5 coordinates miss a pair
at 0.8 with a chance of 3 in a million. Pairs within a band are not emitted: members are checked against the band's
pivot, the member that shares most, and what is then linked is one class. Only bands that still hold several classes go
on, with their next 8, 64, ... pivots against members of other classes, and only with pairs that can reach the
similarity: the weight of a text's shingles that no other open text has bounds what it shares with any of them, and
one-bit signatures of 1,024 coordinates must agree to within five standard errors. So no
link between different texts is lost, and a group of any number of copies costs a few checks a copy. Exact copies are
folded before, by their digest.

Defined results: null texts, and texts without words, are linked to equal texts only (null to none); texts of fewer
than five words are one shingle; a null doc_id is a member of its class but never its id, unless all ids are null;
repeated rows fall into one class; other columns are ignored by ``near_duplicate_classes`` and kept by
``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitloom.llm.common import batches_by_bytes, mix64, ship, stored, words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Darts looked at per document: with so many, a coordinate stays empty with a chance of 1 in 10,000.
DARTS = int(K * 9.2)
#: Coordinates of the one-bit signatures that later rounds compare before any text.
BITS = 1024
_WORDS = [f"bits{i}" for i in range(BITS // 64)]
_SEED = np.uint64(0x5DEECE66D)
_FRACTION = np.uint64(44)
#: Cumulated Poisson chances (mean 1) as unsigned 64-bit thresholds.
_POISSON = np.array(
    [min(int(np.exp(-1) * sum(1 / np.prod(np.arange(1.0, j + 1)) for j in range(i + 1)) * 2**64), 2**64 - 1) for i in range(18)],
    np.uint64,
)


def shingle_hashes(words: list[bytes], numbers: dict[bytes, int], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all ``n``-word shingles in order; fewer words than that are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    get = numbers.get
    codes = []
    for w in words:
        c = get(w)
        if c is None:
            c = numbers[w] = _word_hash(w)
        codes.append(c)
    h = np.array(codes, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return out


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def weighted_set(words: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs."""
    return np.unique(shingle_hashes(words, numbers), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int = K) -> np.ndarray:
    """DartMinHash signatures (``n_sets`` by ``k`` ranks as unsigned integers) of weighted sets laid end to end.

    Weights are positive numbers; a set without elements keeps the empty value (all ones) in every coordinate.
    """
    empty = np.uint64(2**64 - 1)
    out = np.full(n_sets * k, empty, np.uint64)
    totals = np.bincount(owner, weights, n_sets)
    bound = np.divide(DARTS * k / K, totals, out=np.zeros(n_sets), where=totals > 0)
    todo = totals > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        _throw(elements[at], weights[at], owner[at], bound, out, k)
        todo &= (out.reshape(n_sets, k) == empty).any(axis=1)
        bound[todo] *= 2
    return out.reshape(n_sets, k)


def _throw(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, bound: np.ndarray, out: np.ndarray, k: int
) -> None:
    """Darts of all elements below their weight and their set's rank bound, least rank per set and coordinate."""
    wide = np.ceil(weights).astype(np.int64)
    high = np.ceil(bound[owner]).astype(np.int64)
    cells = wide * high
    step = 1 << 19  # cells at a time
    ends = np.cumsum(cells)
    start = 0
    while start < len(elements):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + step, "right")))
        c = cells[start:stop]
        which = np.repeat(np.arange(start, stop), c)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        column, row = nth // high[which], nth % high[which]
        with np.errstate(over="ignore"):
            place = mix64((column.astype(np.uint64) << np.uint64(32)) + row.astype(np.uint64) + _SEED)
            h = mix64(elements[which] ^ place)
        darts = np.searchsorted(_POISSON, h, "right")
        cell = np.repeat(np.arange(len(which)), darts)
        index = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        with np.errstate(over="ignore"):
            d = mix64(h[cell] + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        element, level = which[cell], row[cell]
        rank = (level.astype(np.uint64) << _FRACTION) | (d >> np.uint64(64 - 44))
        keep = level + (d >> np.uint64(11)).astype(np.float64) * 2.0**-53 < bound[owner[element]]
        aside = weights[element] < wide[element]
        if aside.any():  # fractional weights: the last cell counts in part
            across = column[cell] + (mix64(d ^ np.uint64(0xA5A5A5A5)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            keep &= across < weights[element]
        target = owner[element[keep]] * k + (mix64(d[keep] ^ np.uint64(0xC0FFEE)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(out, target, rank[keep])
        start = stop


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of ``ROWS`` coordinates, the band's number hashed in."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = mix64(np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + _SEED, (n, BANDS)).copy())
        for i in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


_NUMBERS: dict[bytes, int] = {}


def _numbers() -> dict[bytes, int]:
    """Word hashes this process has worked out already; bounded."""
    if len(_NUMBERS) > 100_000:
        _NUMBERS.clear()
    return _NUMBERS


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_by_bytes(batch, "text", 1 << 20):
            sets = [weighted_set(words_of(t), _numbers()) for t in part.column("text").to_pylist()]
            sizes = [len(e) for e, _ in sets]
            owner = np.repeat(np.arange(len(sets)), sizes)
            elements = np.concatenate([e for e, _ in sets]) if sets else np.empty(0, np.uint64)
            weights = np.concatenate([w for _, w in sets]).astype(np.float64) if sets else np.empty(0)
            keys = band_keys(signatures(elements, weights, owner, len(sets)))
            has = np.array(sizes) > 0
            totals = np.bincount(owner, weights, len(sets)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(totals), bands], names=["digest", "total", "bands"])


def _similar(threshold: float):
    """The map over (a, text_a, b, text_b) batches that keeps pairs of enough weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_text, kept = None, (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            good = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if y != kept_text:
                    kept_text, kept = y, weighted_set(words_of(y), _numbers())
                good.append(weighted_jaccard(weighted_set(words_of(x), _numbers()), kept) >= threshold)
            mask = pa.array(good, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole else 0.0


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class): the least node that links (a, b) lead to. Large-star and small-star steps until nothing moves.

    Each step is a grouped minimum and a join on a node; hot nodes are pre-aggregated and skew joins split them.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-dedup")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "near-dedup")
        marks = [
            x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, after)
        ]
        edges = after
        if marks[0] == marks[1]:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select("node").join(stars, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("class")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per distinct text: digest, n_rows, first_id (least doc_id), class (long), class_id (least doc_id of
    the class), n_links (checked links of the text). Null texts are left out: they are in no class but their own."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    keyed = source.withColumn("digest", _digest(F.col("text")))
    sketches = keyed.select("digest", "text").mapInArrow(_sketch, "digest binary, total long, bands array<long>")
    ids = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    bands = sketches.groupBy("digest").agg(F.first("bands").alias("bands"), F.first("total").alias("total"))
    # Numbered once and written: a second evaluation could number otherwise.
    texts = stored(ids.join(bands, "digest").withColumn("node", F.monotonically_increasing_id()), "near-dedup")
    members = _shared_bands(texts.select("node", F.explode("bands").alias("band")))
    holders = texts.select("node", "digest", "total").join(members.select("node").distinct(), "node")
    wanted = stored(keyed.select("digest", "text").join(holders, "digest").dropDuplicates(["node"]).select("node", "total", "text"), "near-dedup")
    links, found = _links(members, wanted, similarity)
    classes = texts.select("node").join(found, "node", "left").select("node", F.coalesce("class", "node").alias("class"))
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    )
    placed = texts.drop("bands").join(classes, "node").join(degree, "node", "left")
    lead = placed.groupBy("class").agg(F.min("first_id").alias("class_id"))
    return placed.join(lead, "class").select(
        "digest", "n_rows", "first_id", "class", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _shared_bands(rows: DataFrame) -> DataFrame:
    """(band, node, rank) of bands that several texts share; rank 1 is the band's pivot, who shares most."""
    several = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(rows.join(several, "band"), "near-dedup")
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    return stored(members.join(reach, "node").select("band", "node", "reach"), "near-dedup")


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. ``b`` is the pivot and may be hot: skew joins split it."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "text_a", "b", "text_b")
    return stored(both.mapInArrow(_similar(similarity), "a long, b long"), "near-dedup")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle, weight) rows of (node, text) batches."""
    for batch in batches:
        for part in batches_by_bytes(batch, "text", 1 << 20):
            sets = [weighted_set(words_of(t), _numbers()) for t in part.column("text").to_pylist()]
            nodes = np.repeat(np.asarray(part.column("node")), [len(e) for e, _ in sets])
            elements = np.concatenate([e for e, _ in sets]).view(np.int64)
            weights = np.concatenate([w for _, w in sets]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(elements), pa.array(weights)], names=["node", "shingle", "weight"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, words) rows of (node, text) batches: one bit of each of ``BITS`` signature coordinates, in 64-bit words."""
    for batch in batches:
        for part in batches_by_bytes(batch, "text", 1 << 18):
            sets = [weighted_set(words_of(t), _numbers()) for t in part.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
            elements = np.concatenate([e for e, _ in sets])
            weights = np.concatenate([w for _, w in sets]).astype(np.float64)
            bits = (mix64(signatures(elements, weights, owner, len(sets), BITS)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits, axis=1).view(np.int64)
            offsets = pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32())
            words = pa.ListArray.from_arrays(offsets, pa.array(packed.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("node"), words], names=["node", "bits"])


def _reachable(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, total, common, bits0, ...): a text's weight, its weight in shingles that another of ``nodes`` has too, and
    one bit of each of ``BITS`` signature coordinates.

    What two texts share is at most either's common weight, so a text whose common weight is below ``similarity`` of
    its own has no link to any of ``nodes`` and is left out.
    """
    rows = texts.join(nodes, "node").mapInArrow(_elements, "node long, shingle long, weight long")
    alone = (
        rows.groupBy("shingle")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"), F.sum("weight").alias("weight"))
        .groupBy(F.when(F.col("node") == F.col("other"), F.col("node")).alias("node"))
        .agg(F.sum("weight").alias("own"))
    )
    sizes = texts.join(nodes, "node").select("node", "total")
    found = sizes.join(alone, "node", "left").withColumn("common", F.col("total") - F.coalesce("own", F.lit(0)))
    able = found.filter(F.col("common") >= similarity * F.col("total")).select("node", "total", "common")
    bits = texts.join(able.select("node"), "node").select("node", "text").mapInArrow(_bits, "node long, bits array<long>")
    return able.join(bits, "node").select("node", "total", "common", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)])


def _links(members: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All links needed for the classes, and the classes (node, class) of members: rounds of pivots until no band can hold a link between two classes."""
    # The pivot of a band by a grouped maximum: no window over a hot band.
    pivot = members.groupBy("band").agg(F.max(F.struct("reach", "node")).alias("top")).select("band", F.col("top.node").alias("b"))
    pairs = members.join(pivot, "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _checked(pairs, texts, similarity)
    nodes = members.select("node").distinct()
    classes = stored(connected(nodes, links), "near-dedup")
    left = stored(_open(members.join(classes, "node")), "near-dedup")
    if left.isEmpty():
        return links, classes
    # Every pivot was checked against all of its bands; what follows needs no pair without enough in common.
    # A pair is taken up in the first of the bands it shares, and in no other.
    bounds = stored(_reachable(left.select("node").distinct(), texts, similarity), "near-dedup")
    left = left.join(bounds.select("node"), "node").select("band", "node", "reach", "class")
    bands_of = left.groupBy("node").agg(F.collect_set("band").alias("bands"))  # ``BANDS`` at most
    bounds = stored(bounds.join(bands_of, "node"), "near-dedup")
    first, last = 0, 8  # pivots done in every band, and the last of the next round
    while True:
        # Bands without a member behind the next pivot are done. What is compared joins the rows of the others only.
        left = stored(_open(left, first + 2), "near-dedup")
        if left.isEmpty():
            return links, classes
        order = Window.partitionBy("band").orderBy(F.col("reach").desc(), F.col("node").desc())
        ranked = left.join(bounds, "node").withColumn("nth", F.row_number().over(order))
        pivots = ranked.filter((F.col("nth") > first) & (F.col("nth") <= last)).select(
            "band", *[F.col(c).alias(f"{c}_b") for c in ("node", "class", "nth", "total", "common", "bands", *_WORDS)]
        )
        enough = similarity / (1 + similarity) * (F.col("total") + F.col("total_b"))
        may_link = (
            (F.col("nth") > F.col("nth_b"))
            & (F.col("class") != F.col("class_b"))
            & (F.least("common", "common_b") >= enough - 1e-6)
            & (sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in _WORDS) <= most_differing(similarity))
            & (F.col("band") == F.array_min(F.array_intersect("bands", "bands_b")))
        )
        pairs = stored(
            ranked.join(pivots, "band").filter(may_link).select(F.col("node").alias("a"), F.col("node_b").alias("b")),
            "near-dedup",
        )
        fresh = _checked(pairs, texts, similarity) if not pairs.isEmpty() else None
        if fresh is not None and not fresh.isEmpty():
            links = stored(links.unionAll(fresh), "near-dedup")
            classes = stored(connected(nodes, links), "near-dedup")
            left = left.drop("class").join(classes, "node")
        first, last = last, 8 * last


def most_differing(similarity: float) -> int:
    """Differing bits of two texts of this similarity, at most: five standard errors (3 in 10 million) above the mean."""
    p = (1 - similarity) / 2
    return int(BITS * p + 5 * (BITS * p * (1 - p)) ** 0.5) + 1


def _open(placed: DataFrame, least: int = 2) -> DataFrame:
    """The rows of bands that hold more than one class and ``least`` members or more."""
    several = placed.groupBy("band").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size")
    )
    return placed.join(several.filter((F.col("low") != F.col("high")) & (F.col("size") >= least)).select("band"), "band")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class) and n_links of its text."""
    classes = near_duplicate_classes(docs, similarity)
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", F.when(text.isNotNull(), _digest(text)).alias("digest"))
    joined = keyed.join(classes.select("digest", "class_id", "n_links"), "digest", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns): one of each class, that of least doc_id; every row without a text."""
    classes = near_duplicate_classes(docs, similarity)
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("digest"))
    lead = classes.groupBy("class").agg(F.min_by(F.struct("digest", "first_id", "n_rows"), order).alias("lead"))
    stay = lead.select(
        F.col("lead.digest").alias(_KEY), F.col("lead.first_id").alias(f"{_KEY}_id"), F.col("lead.n_rows").alias(f"{_KEY}_n")
    )
    text = F.col("text").cast("string")
    found = docs.withColumn(_KEY, _digest(text)).join(stay, _KEY)
    found = found.filter(F.col("doc_id").eqNullSafe(F.col(f"{_KEY}_id")))
    alone = found.filter(F.col(f"{_KEY}_n") == 1)
    # Copies with the same id: one of them.
    copies = found.filter(F.col(f"{_KEY}_n") > 1).dropDuplicates([_KEY])
    kept = alone.unionByName(copies).drop(_KEY, f"{_KEY}_id", f"{_KEY}_n")
    return kept.unionByName(docs.filter(text.isNull()))


_KEY = "__pitloom_digest"
