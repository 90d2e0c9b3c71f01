"""Operator 12: alignment of two tokenizers over a corpus, by external counting of their linked token pairs.

Both tokenizers encode every text; tokens whose byte ranges overlap are linked, and byte offsets where tokens of both end cut
them into groups. How many documents hold an id pair linked is counted over the whole corpus, outside memory:

1. Texts are taken in chunks. A chunk's pair-document records (pair, document, times) are sorted by pair, side-major (A id, then
   B id), parted by the low bits of the A id (the radix), and written as zstd runs: a head (pairs, and the documents of each) and
   a tail (documents and times, in the same order).
2. The heads of a radix are merged by a heap, ``FAN`` runs at a time, until one run is left; equal pairs meet and their documents
   add up. All pairs of an A id lie together in it, so its highest count is known when its last pair has passed.
3. The counts stream back: each run looks up its pairs, in order, and each chunk adds up what the counts give its documents.

A head holds a pair once a chunk, however many documents share it, so a pair or an A id that is in every document makes no run
longer than the vocabulary; tails never leave their chunk. Runs, merged runs and answers are rows in the shared folder.

Texts are encoded in units that both tokenizers keep apart: a cut lies before each space that follows a non-space and has a
non-space behind it. A's pattern never spans such a place, and B's pieces do not when none holds a space mark behind another
character (checked; otherwise a text is one unit). Units met before are remembered, in bounded number.

Defined results: null and empty texts, and texts that either tokenizer does not give back, have no tokens: zeros and ''. A
token's bytes are those of its vocabulary entry. Repeated ids and rows are documents of their own, and each counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pitloom.llm.common import batches_by_bytes, ship, stored

#: Words of a chunk (one document at least), radixes, runs merged at a time, units remembered.
CHUNK_WORDS, RADIXES, FAN, REMEMBERED = 1 << 20, 64, 64, 300_000

_CUT = re.compile(r"(?<=\S)(?= \s*\S)")
_ODD = re.compile(r" \s|\s |\A\s|\s\Z")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_MARK = "▁"

_RUN = "chunk long, radix int, head binary, tail binary"
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COLUMNS = [c.split()[0] for c in _DOC.split(", ")]
_CHUNK = _RUN + "".join(f", {c} array<{t}>" for c, t in (x.split() for x in _DOC.split(", ")))
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all tokens whose ranges overlap; ranges lie end to end from 0 on both sides."""
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    first = np.searchsorted(ends_b, starts_a, side="right")
    behind = np.searchsorted(starts_b, ends_a, side="left")
    n = behind - first
    return np.repeat(np.arange(len(ends_a)), n), spread(first, n)


class Units:
    """What a unit's alignment gives, by number: token, group and link counts, its groups as text, and its linked pairs."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.fit = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.ends = np.zeros(0, np.int64)


class Aligner:
    """The two tokenizers, and the units met so far. ``definition``: a tokenizer with a byte-level vocabulary, as JSON;
    ``model``: a piece model's bytes."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            if all(c in alphabet for c in entry):
                self.bytes_a[number] = bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.match(p)) else p.replace(_MARK, " ").encode() for p in pieces
        ]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        pattern = json.loads(definition).get("pre_tokenizer") or {}
        self.parted = (
            pattern.get("type") == "ByteLevel"
            and pattern.get("use_regex", True)
            and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        )
        self.units = Units()

    def split(self, text: str) -> list[str]:
        """The units of a space and the text, without the space that each begins with."""
        if not self.parted:
            return [text]
        if not _ODD.search(text):
            return text.split(" ")
        return [u[1:] for u in _CUT.split(" " + text)]

    def learn(self, new: list[str]) -> None:
        u = self.units
        raw = [b" " + w.encode() for w in new]
        a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        fit = np.array(
            [
                b"".join([self.bytes_a[i] for i in x]) == r and b"".join([self.bytes_b[i] for i in y]) == r
                for x, y, r in zip(a, b, raw, strict=True)
            ],
            bool,
        )
        for k in np.flatnonzero(~fit):
            a[k], b[k] = [], []
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        ids_a, ids_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        left, right = overlaps(ends_a, ends_b)
        stops_a, stops_b = np.cumsum(n_a), np.cumsum(n_b)
        unit_of_a = np.repeat(np.arange(len(new)), n_a)
        unit = unit_of_a[left]
        pairs = ids_a[left] << 32 | ids_b[right]
        order = np.lexsort((pairs, unit))
        unit, pairs = unit[order], pairs[order]
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pairs[1:] != pairs[:-1])]) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(pairs)])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)  # every token has bytes
        cut_a, cut_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        group_unit = unit_of_a[cut_a - 1]
        counts = np.stack(
            [n_a, n_b, np.bincount(group_unit, minlength=len(new)), np.bincount(unit, minlength=len(new))], axis=1
        )
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups = [
            ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
            for i, j, k, m in zip([0, *cut_a[:-1].tolist()], cut_a.tolist(), [0, *cut_b[:-1].tolist()], cut_b.tolist(), strict=True)
        ] if len(both) else []
        at = np.cumsum(counts[:, 2])
        u.texts += [";".join(groups[i:j]).encode() for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]
        start = len(u.number)
        u.number.update(zip(new, range(start, start + len(new)), strict=True))
        u.counts = np.concatenate([u.counts, counts])
        u.fit = np.concatenate([u.fit, fit])
        u.ends = np.concatenate([u.ends, len(u.pairs) + np.cumsum(np.bincount(unit[first], minlength=len(new)))])
        u.pairs = np.concatenate([u.pairs, pairs[first]])
        u.times = np.concatenate([u.times, times])

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts end to end, by number, and the number of units of each."""
        parts = [self.split(t) if t else [] for t in texts]
        known = self.units.number
        new = list(dict.fromkeys(w for p in parts for w in p if w not in known))
        for start in range(0, len(new), 20_000):
            self.learn(new[start : start + 20_000])
        codes = np.fromiter((known[w] for p in parts for w in p), np.int64)
        return codes, np.array([len(p) for p in parts], np.int64)


_ALIGNERS: dict[str, Aligner] = {}


def aligner(definition: str, model: bytes) -> Aligner:
    """One a process and pair of tokenizers, so that tasks in one worker share the units met."""
    key = hashlib.sha256(definition.encode() + b"\0" + model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(definition, model)
    return _ALIGNERS[key]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers as one zstd frame, each in the narrowest type that holds it."""
    head, body = struct.pack("<B", len(arrays)), []
    for x in arrays:
        kind = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
        head += struct.pack("<BQ", kind, len(x))
        body.append(x.astype(f"<u{kind}").tobytes())
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(body))


def unpack(frame: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n, at = raw[0], 1
    kinds = [struct.unpack_from("<BQ", raw, at + 9 * k) for k in range(n)]
    at += 9 * n
    out = []
    for kind, length in kinds:
        out.append(np.frombuffer(raw, f"<u{kind}", length, at).astype(np.int64))
        at += kind * length
    return out


def pack_head(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(np.diff(pairs, prepend=0), counts)


def unpack_head(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(frame)
    return np.cumsum(steps), counts


def records(units: Units, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, times), side-major, of documents whose units lie end to end."""
    n_units = max(len(units.texts), 1)
    keys, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n_units + codes, return_counts=True)
    document, unit = keys // n_units, keys % n_units
    starts = np.concatenate([[0], units.ends])[unit]
    sizes = units.ends[unit] - starts
    at = spread(starts, sizes)
    # Few different pairs are in a chunk: their numbers, in order, stand for them in the sort.
    used = np.unique(unit)
    pairs = np.unique(units.pairs[spread(np.concatenate([[0], units.ends])[used], (units.ends - np.concatenate([[0], units.ends[:-1]]))[used])])
    rank = np.searchsorted(pairs, units.pairs[at])
    key = rank * max(len(lengths), 1) + np.repeat(document, sizes)
    times = units.times[at] * np.repeat(n, sizes)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, first) if len(first) else times
    key = key[first]
    return pairs[key // max(len(lengths), 1)], key % max(len(lengths), 1), times


class Chunk:
    """Documents gathered until they hold enough words."""

    def __init__(self, coder: Aligner):
        self.coder, self.codes, self.lengths = coder, [], []
        self.rows: dict[str, list] = {c: [] for c in _COLUMNS}
        self.words = 0

    def add(self, doc_ids: list, texts: list[str | None]) -> None:
        codes, lengths = self.coder.numbered(texts)
        u = self.coder.units
        ends = np.cumsum(lengths)
        upto = np.concatenate([[0], np.cumsum(~u.fit[codes])])
        whole = (upto[ends] == upto[ends - lengths]) & (lengths > 0)
        kept = np.repeat(whole, lengths)
        codes, lengths = codes[kept], np.where(whole, lengths, 0)
        ends = np.cumsum(lengths)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(u.counts[codes], axis=0)])
        counts = sums[ends] - sums[ends - lengths]
        texts_of = u.texts
        numbers = codes.tolist()
        for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            self.rows[c] += counts[:, k].tolist()
        self.rows["doc_id"] += doc_ids
        self.rows["groups_sha256"] += [
            hashlib.sha256(b";".join([texts_of[c] for c in numbers[e - n : e]])).hexdigest() if n else ""
            for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)
        ]
        self.codes.append(codes)
        self.lengths.append(lengths)
        self.words += len(codes)

    def rows_out(self, chunk: int) -> pa.RecordBatch:
        """The chunk's runs, and a row (radix -1) with the columns of its documents."""
        pairs, document, times = records(self.coder.units, np.concatenate(self.codes), np.concatenate(self.lengths))
        radix = (pairs >> 32) % RADIXES
        radixes, heads, tails = [-1], [None], [None]
        order = np.argsort(radix, kind="stable")
        pairs, document, times, radix = pairs[order], document[order], times[order], radix[order]
        for r in np.unique(radix).tolist():
            part = slice(np.searchsorted(radix, r, "left"), np.searchsorted(radix, r, "right"))
            run, counts = np.unique(pairs[part], return_counts=True)
            radixes.append(r)
            heads.append(pack_head(run, counts))
            tails.append(pack(document[part], times[part]))
        n = len(radixes)
        columns = [pa.array([chunk] * n, pa.int64()), pa.array(radixes, pa.int32()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())]
        for c in _COLUMNS:
            kind = pa.string() if c == "groups_sha256" else pa.int64()
            columns.append(pa.array([self.rows[c]] + [None] * (n - 1), pa.list_(kind)))
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "radix", "head", "tail", *_COLUMNS])


def runs(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    """The runs of all chunks, and a row of radix -1 a chunk with the columns of its documents."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((definition, model))  # the tokenizers' files, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(*shared.value)
        task, nth = TaskContext.get().partitionId(), 0
        chunk = Chunk(coder)
        for batch in batches:
            for part in batches_by_bytes(batch, "text", 1 << 20):
                chunk.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                if chunk.words >= CHUNK_WORDS:
                    yield chunk.rows_out(task << 32 | nth)
                    nth += 1
                    if len(coder.units.texts) > REMEMBERED:
                        coder.units = Units()
                    chunk = Chunk(coder)
        if chunk.rows["doc_id"]:
            yield chunk.rows_out(task << 32 | nth)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _CHUNK)


def _stream(frame: bytes, block: int = 4096) -> Iterator[tuple[int, int]]:
    pairs, counts = unpack_head(frame)
    for start in range(0, len(pairs), block):
        yield from zip(pairs[start : start + block].tolist(), counts[start : start + block].tolist(), strict=True)


def merge(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of several heads, in order, and the sums of their counts, by a heap of the heads."""
    pairs: list[int] = []
    counts: list[int] = []
    last = -1
    for pair, n in heapq.merge(*map(_stream, frames)):
        if pair == last:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
            last = pair
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; pairs are in side-major order."""
    if not len(pairs):
        return np.zeros(0, bool)
    side = pairs >> 32
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
    most = np.maximum.reduceat(counts, first)
    return counts == np.repeat(most, np.diff(np.r_[first, len(pairs)]))


def _merged(rows: pa.Table) -> pa.Table:
    head = pack_head(*merge(rows.column("head").to_pylist()))
    return pa.table({c: rows.column(c)[:1].cast(t) for c, t in (("radix", pa.int32()), ("bundle", pa.int64()))} | {"head": pa.array([head], pa.binary())})


def pair_counts(heads: DataFrame, n_runs: int) -> DataFrame:
    """(radix, head): one merged run for each radix of ``heads`` (radix, run, head), merged ``FAN`` runs at a time."""
    level = heads.select("radix", F.col("run").alias("bundle"), "head")
    while True:
        n_runs = max(1, ceil(n_runs / FAN))
        dealt = level.withColumn("bundle", F.pmod(F.xxhash64("bundle"), F.lit(n_runs)))
        level = stored(dealt.groupBy("radix", "bundle").applyInArrow(_merged, "radix int, bundle long, head binary"), "alignment")
        if n_runs == 1:
            return level.select("radix", "head")


def counted(heads: DataFrame) -> DataFrame:
    """(a, b, documents, best) of each linked pair of merged ``heads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.column("head").to_pylist():
                pairs, counts = unpack_head(head)
                columns = [pairs >> 32, pairs & 0xFFFFFFFF, counts, best(pairs, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "documents", "best"])

    return heads.select("head").mapInArrow(run, "a long, b long, documents long, best boolean")


def _answers(runs_of: pa.Table, whole: pa.Table) -> pa.Table:
    """Each run's pairs looked up in the merged run of its radix."""
    pairs, counts = unpack_head(whole.column("head")[0].as_py())
    highest = best(pairs, counts)
    found = []
    for head in runs_of.column("head").to_pylist():
        at = np.searchsorted(pairs, unpack_head(head)[0])
        found.append(pack(counts[at], highest[at].astype(np.int64)))
    return pa.table({"chunk": runs_of.column("chunk"), "radix": runs_of.column("radix"), "answer": pa.array(found, pa.binary())})


def _sums(documents: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by document: low and high halves, so that doubles hold each."""
    low = np.bincount(documents, (values & 0xFFFFFFF).astype(np.float64), n).astype(np.int64)
    high = np.bincount(documents, (values >> 28).astype(np.float64), n).astype(np.int64)
    return low + (high << 28)


def _contributions(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a chunk's documents, with what the pairs' counts give each."""
    rows = chunk.to_pylist()
    own = next(r for r in rows if r["radix"] < 0)
    n = len(own["doc_id"])
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    answer = dict(zip(answers.column("radix").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    for r in rows:
        if r["radix"] < 0:
            continue
        sizes = unpack_head(r["head"])[1]
        documents, times = unpack(r["tail"])
        counts, highest = unpack(answer[r["radix"]])
        n_best += _sums(documents, times * np.repeat(highest, sizes), n)
        count_sum += _sums(documents, times * np.repeat(counts, sizes), n)
    columns = {c: pa.array(own[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in _COLUMNS}
    columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in _RESULT.split(", ")})


def align(docs: DataFrame, definition: str, model: bytes) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row for each document, and (a, b, documents, best) for each linked pair of the corpus."""
    made = stored(runs(docs, definition, model), "alignment")
    heads = made.filter("radix >= 0").select("chunk", "radix", "head")
    n_chunks = made.filter("radix < 0").count()
    merged = pair_counts(heads.select("radix", F.col("chunk").alias("run"), "head"), n_chunks)
    # A merged run goes to each bundle of its radix's runs.
    bundles = max(1, ceil(n_chunks / FAN))
    dealt = heads.withColumn("bundle", F.pmod(F.xxhash64("chunk"), F.lit(bundles)))
    whole = merged.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)).cast("array<bigint>")))
    answers = (
        dealt.groupBy("radix", "bundle").cogroup(whole.groupBy("radix", "bundle")).applyInArrow(_looked_up, "chunk long, radix int, answer binary")
    )
    answers = stored(answers, "alignment")
    rows = made.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_contributions, _RESULT)
    return rows, counted(merged)


def _looked_up(runs_of: pa.Table, whole: pa.Table) -> pa.Table:
    if not len(runs_of) or not len(whole):  # a bundle without runs of this radix
        return pa.table({"chunk": pa.array([], pa.int64()), "radix": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
    return _answers(runs_of, whole)
