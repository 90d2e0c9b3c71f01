"""Operator 7: token ids in binary shards, compressed by Re-Pair grammars.

Documents are dealt into ranges of ascending doc_id and encoded; the ids of some ``SHARD_IDS`` tokens become one shard.
In a shard the most frequent neighbouring pairs of symbols are replaced by new symbols (nonterminals), again and again,
until no pair is frequent or the grammar is full. Pairs never cross documents, so any document, and by the rules'
expansion lengths any stretch of it, is decoded without its neighbours.

A shard is one binary value in a row that Spark writes and reads (its committer keeps a lost task's half-written files
out): magic ``RPS1``, then five little-endian 64-bit counts (documents, ids, rules, symbols, first nonterminal), then
the arrays: document ids (i8) and whether they are set (u1), each document's end among the symbols (i8) and among the
ids (i8), rules as pairs (u4), expansion lengths of the rules (u4), symbols (u2 if they fit, else u4).

Defined results: a null text is an empty one (just the end id); null doc_ids come first; rows of one doc_id follow each
other in order of their texts' first 64 characters, then of a hash, over as many tasks as they need; an empty table
gives no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitloom.llm.byte_bpe import Lists, Numbering, spread
from pitloom.llm.common import batches_by_bytes, ship
from pitloom.session import scratch_path

END_ID = 2
SHARD_IDS = 1 << 20
#: Least count of a pair worth a rule, rules of a round, and rules of a shard (symbols then fit 16 bits).
MIN_COUNT, ROUND_RULES, RULES = 8, 6000, 12_000
REMEMBERED = 1_000_000
#: Bytes of text encoded together, of which equal words are looked up once.
ENCODE_BYTES = 6 << 20
#: Rules of so many ids at most are looked up whole when a shard is decoded.
SHORT_RULE = 64

_MAGIC = b"RPS1"
_HEAD = struct.Struct("<4s5q")
_MARK = "\x01"
#: Characters up to U+02FF are composed already and have a lower case each of its own, but for U+0130. Control characters
#: and white space beyond ASCII's are left to the library, too.
_NOT_PLAIN = "[\x01\x1c-\x1f\x85\xa0\u0130\u0300-\U0010ffff]"


def split_pattern(model: dict) -> str | None:
    """The pattern by which a tokenizer cuts its pieces, if it composes characters, folds white space, lowers case, keeps
    the pattern's matches as pieces in bytes and ends each piece's last token alike; else null."""
    normal, pre, bpe = model.get("normalizer") or {}, model.get("pre_tokenizer") or {}, model["model"]
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        return None
    split, *rest = pre.get("pretokenizers") or [{}]
    matches_only = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    in_bytes = [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in rest] == [("ByteLevel", False, False)]
    pattern = split.get("pattern", {}).get("Regex")
    if not (matches_only and in_bytes and pattern and bpe.get("end_of_word_suffix") and not bpe.get("dropout")):
        return None
    return pattern if regex.compile(pattern).groups == 0 else None


class Encoder:
    """A tokenizer that drops white space, with the ids of words met before. White space parts words for good: the
    tokenizer's pieces never span it, so a text's ids are its words' ids end to end. Special strings, which the library
    reads as their tokens, hold no white space and stay inside a word.

    New words whose characters all are plain are cut into the tokenizer's pieces together, and the library encodes the
    new ones of these; it reads any other word, and every word of a tokenizer of another kind, as a whole."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        model = json.loads(definition)
        pattern = split_pattern(model)
        self.cut = regex.compile(f"{pattern}|\n") if pattern else None
        if pattern:
            special = [re.escape(t["content"]) for t in model["added_tokens"]]
            self.not_plain = re.compile("|".join([_NOT_PLAIN, *special]))
            suffix, vocab = model["model"]["end_of_word_suffix"], model["model"]["vocab"]
            self.ends_piece = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_piece[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            model["normalizer"], model["added_tokens"] = None, []
            model["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.of_pieces = Tokenizer.from_str(json.dumps(model))
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = Numbering(), Lists()
        self.pieces, self.piece_ids = Numbering(), Lists()

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words: many in one text, parted by a mark that is a token of its own and in none."""
        done = [(np.empty(0, np.uint32), np.empty(0, np.int64))]
        for start in range(0, len(words), 4000):
            some = [w if _MARK not in w else "" for w in words[start : start + 4000]]
            text = f" {_MARK} ".join(["", *some, ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lengths = np.diff(marks) - 1
            plain = ids[marks[0] :][ids[marks[0] :] != self.mark]
            with_mark = [i for i, w in enumerate(words[start : start + 4000]) if _MARK in w]
            if with_mark:  # word by word
                lists = np.split(plain, np.cumsum(lengths)[:-1])
                for i in with_mark:
                    lists[i] = np.array(self.tokenizer.encode(words[start + i], add_special_tokens=False).ids, np.uint32)
                plain, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
            done.append((plain, lengths))
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _by_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words whose characters are plain, by way of their pieces; a line break ends each word."""
        found = self.cut.findall("\n".join([*words, ""]).lower())
        codes = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        new = list(islice(self.pieces, len(self.piece_ids), None))
        for start in range(0, len(new), 1000):
            some = new[start : start + 1000]
            text = " ".join(some)  # a line break is white space: no token
            ids = np.array(self.of_pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends_piece[ids]) + 1
            lengths = np.zeros(len(some), np.int64)
            lengths[[x != "\n" for x in some]] = np.diff(stops, prepend=0)
            self.piece_ids.extend(ids, lengths)
        flat, lengths = self.piece_ids.take(codes)
        upto = np.cumsum(lengths)[codes == self.pieces["\n"]]
        return flat, np.diff(upto, prepend=0)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, in the order of their numbers."""
        if self.cut is None or not words:
            self.ids.extend(*self._whole(words))
            return
        odd = [self.not_plain.search(w) is not None for w in words]
        flat, lengths = self._by_pieces([w for w, x in zip(words, odd, strict=True) if not x])
        if any(odd):
            more, lengths_of_odd = self._whole([w for w, x in zip(words, odd, strict=True) if x])
            both = Lists()
            both.extend(np.concatenate([flat, more]), np.concatenate([lengths, lengths_of_odd]))
            flat, lengths = both.take(np.argsort(np.argsort(odd, kind="stable"), kind="stable"))
        self.ids.extend(flat, lengths)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's ids."""
        if len(self.words) > REMEMBERED:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # an empty word has no ids
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        self._learn(list(islice(self.words, len(self.ids), None)))
        flat, lengths = self.ids.take(numbers[np.asarray(coded.indices)])
        stops = np.cumsum(np.asarray(pc.list_value_length(split), np.int64))
        upto = np.concatenate([[0], np.cumsum(lengths)])[stops]
        return flat, np.diff(upto, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder a process and definition, so that tasks in one worker share the words met."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def places(chosen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key among the distinct ``chosen``, or -1, by small hash tables: a chosen key that loses its slot
    to another, and the keys that met another one there, go on to a table with the next multiplier."""
    out = np.full(len(keys), -1, np.int64)
    left, rest, odd = np.arange(len(chosen)), np.arange(len(keys)), 0x9E3779B97F4A7C15
    while len(left) and len(rest):
        table = np.full(1 << 16, -1, np.int64)
        slots = (chosen[left] * np.uint64(odd)) >> np.uint64(48)
        table[slots] = left
        at = table[(keys[rest] * np.uint64(odd)) >> np.uint64(48)]
        rest, at = rest[at >= 0], at[at >= 0]
        same = chosen[at] == keys[rest]
        out[rest[same]] = at[same]
        rest, left = rest[~same], left[table[slots] != left]
        odd = (odd * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
    return out


def compress(ids: np.ndarray, counts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document ends among the symbols, rules) of documents' ids end to end; rule r is symbol ``first + r``."""
    symbols = ids.astype(np.uint64)
    ends = np.cumsum(counts)
    rules: list[np.ndarray] = []
    made = 0
    while len(symbols) > 1 and made < RULES:  # each round replaces a frequent pair at least
        keys = (symbols[:-1] << np.uint64(32)) | symbols[1:]
        inside = np.ones(len(keys), bool)
        cuts = ends[(ends > 0) & (ends < len(symbols))]
        inside[cuts - 1] = False
        pairs, n = np.unique(keys[inside], return_counts=True)
        often = np.flatnonzero(n >= MIN_COUNT)
        room = min(ROUND_RULES, RULES - made)
        if len(often) > room:
            often = often[np.lexsort((pairs[often], -n[often]))[:room]]
            often.sort()
        if not len(often):
            break
        chosen = pairs[often]
        at = places(chosen, keys)
        hit = inside & (at >= 0)
        # Of pairs that share a symbol every second one, from the first.
        where = np.flatnonzero(hit)
        begins = np.ones(len(where), bool)
        begins[1:] = np.diff(where) > 1
        run = np.maximum.accumulate(np.where(begins, where, 0))
        where = where[(where - run) % 2 == 0]
        symbols[where] = np.uint64(first + made) + at[where].astype(np.uint64)
        gone = np.zeros(len(symbols) + 1, bool)
        gone[where + 1] = True
        ends = ends - np.cumsum(gone)[np.maximum(ends - 1, 0)] * (ends > 0)
        symbols = symbols[~gone[:-1]]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1))
        made += len(chosen)
    grammar = np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)
    return symbols.astype(np.uint32), ends, grammar.astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's symbols are ids or earlier rules."""
    out = np.ones(len(rules), np.int64)
    # One level of rules at a time: repeat until nothing changes.
    while len(rules):
        sizes = np.concatenate([[1], out])
        new = sizes[np.where(rules >= first, rules.astype(np.int64) - first + 1, 0)].sum(axis=1)
        if np.array_equal(new, out):
            break
        out = new
    return out


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The bytes of one shard."""
    first = int(ids.max()) + 1 if len(ids) else 0
    symbols, ends, rules = compress(ids, counts, first)
    lengths = expansion_lengths(rules, first)
    wide = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(rules), len(symbols), first)
    arrays = (
        (np.array([d or 0 for d in doc_ids]), "<i8"), (np.array([d is not None for d in doc_ids]), "u1"), (ends, "<i8"),
        (np.cumsum(counts), "<i8"), (rules, "<u4"), (lengths, "<u4"), (symbols, wide),
    )
    return head + b"".join(np.ascontiguousarray(a).astype(t).tobytes() for a, t in arrays)


class Shard:
    """A reader of one shard's bytes; documents, and stretches of them, are decoded one by one or all together."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_ids, rules, n_symbols, self.first = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.symbol_ends, self.id_ends = take(docs, "<i8"), take(docs, "<i8")
        self.rules = take(2 * rules, "<u4").reshape(rules, 2)
        self.lengths = take(rules, "<u4")
        self.symbols = take(n_symbols, "<u2" if self.first + rules <= 1 << 16 else "<u4")

    def _open(self, symbols: np.ndarray, least: int) -> np.ndarray:
        """Symbols with every rule of ``least`` ids or more replaced by its pair, level by level."""
        out = symbols.astype(np.int64)
        while (rule := self.sizes[out] >= least).any():
            size = np.where(rule, 2, 1)
            at = np.cumsum(size) - size
            opened = np.empty(int(size.sum()), np.int64)
            opened[at] = out
            pair = self.rules[out[rule] - self.first]
            opened[at[rule]], opened[at[rule] + 1] = pair[:, 0], pair[:, 1]
            out = opened
        return out

    @cached_property
    def sizes(self) -> np.ndarray:
        """The number of ids that each symbol stands for."""
        return np.concatenate([np.ones(self.first, np.int64), self.lengths])

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every symbol of few ids, end to end, and where each symbol's begin."""
        few = np.flatnonzero(self.sizes <= SHORT_RULE)
        starts = np.zeros(len(self.sizes), np.int64)
        starts[few] = np.cumsum(self.sizes[few]) - self.sizes[few]
        return self._open(few, 2).astype(np.uint32), starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: long rules are opened level by level, what remains is looked up."""
        out = self._open(symbols, SHORT_RULE + 1)
        ids, starts = self.short
        return ids[spread(starts[out], self.sizes[out])]

    def document(self, nth: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the ``nth`` document; only the symbols that cover them are opened."""
        symbols = self.symbols[self.symbol_ends[nth - 1] if nth else 0 : self.symbol_ends[nth]].astype(np.int64)
        sizes = self.sizes[symbols]
        upto = np.cumsum(sizes)
        stop = int(upto[-1]) if stop is None and len(upto) else (stop or 0)
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
        skipped = int(upto[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts hold about ``limit`` bytes: small ones joined, large ones sliced (one row at least)."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in batches_by_bytes(batch, "text", limit):
            some.append(piece)
            size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
            if size >= limit:
                yield pa.concat_batches(some)
                some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def make_shards(docs: DataFrame, definition: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of all documents in ascending doc_id: part, nth (in the part), n_docs, n_ids, payload."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a tokenizer's definition, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        part, nth = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            payload = pack(doc_ids, np.concatenate(ids), np.concatenate(counts))
            columns = [[part], [nth], [len(doc_ids)], [size], [payload]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["part", "nth", "n_docs", "n_ids", "payload"],
            )

        for piece in gathered(batches, ENCODE_BYTES):
            flat, n = coder.encode(piece.column("text"))
            with_end = np.insert(flat, np.cumsum(n), end_id)
            keys, stops, done = piece.column("doc_id").to_pylist(), np.cumsum(n + 1), 0
            while done < len(keys):  # the documents that fill the shard, the last one whole
                start = int(stops[done - 1]) if done else 0
                upto = min(len(keys), int(np.searchsorted(stops, start + shard_ids - size)) + 1)
                doc_ids += keys[done:upto]
                ids.append(with_end[start : stops[upto - 1]])
                counts.append(n[done:upto] + 1)
                size += len(ids[-1])
                done = upto
                if size >= shard_ids:
                    yield shard()
                    nth += 1
                    doc_ids, ids, counts, size = [], [], [], 0
        if doc_ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("head").asc(), F.col("hash").asc(), F.col("row").asc()]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumns(
            {"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, "part int, nth int, n_docs long, n_ids long, payload binary")


def write_shards(docs: DataFrame, definition: str, path: str, end_id: int = END_ID) -> None:
    make_shards(docs, definition, end_id).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(spark)
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "payload")), strict=True)
            for part, nth, payload in rows:
                shard = Shard(payload)
                ids = shard.expand(shard.symbols).astype("<u4")
                starts = np.concatenate([[0], shard.id_ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, shard.id_ends, strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([nth] * n, pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts),
                        pa.array(shard.id_ends - starts),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "nth", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    decoded = shards.select("part", "nth", "payload").mapInArrow(
        run, "part int, nth int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    # Offsets in two levels: shards of a part, then parts.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.select("part", "nth", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start"))
        .join(parts, "part")
        .select("part", "nth", (F.col("part_start") + F.col("shard_start")).alias("offset"))
    )
    return decoded.join(offsets, ["part", "nth"]).select(
        "doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, definition: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` to a fresh path in the shared folder and read all documents back."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, definition, path, end_id)
    return read_documents(docs.sparkSession, path)
