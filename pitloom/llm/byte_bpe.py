"""Operator 2: byte-level BPE with DuckDB recursive queries inside each partition.

A text is split by the tokenizer's pattern into pieces ("words"). Each task keeps an in-process DuckDB database with
the merge table (left id, right id, merged id = rank). The pieces that a task has not met before become token-position
rows, one per byte, and a recursive query contracts, in every word, the leftmost pair of minimum rank until no pair of
a word is in the merge table. Decoding joins ids to the token bytes and concatenates them by an ordered aggregation.

Long words are first cut wherever no token that occurs in them reaches across, which no contraction can cross. Segments
that are still long (runs of one character, say) use the same rule in a second recursive query that contracts, in one
step, every non-overlapping pair of the minimum rank (left to right) where no pair made with the merged token can have a
lower rank; else all from the left to the first whose token makes such a pair with a neighbour, which is next then.
Both give tiktoken's ids. A whole piece that is itself a token takes that id at once, as in tiktoken.

Defined results: a null text is encoded as an empty one (no ids); null ids decode to null (and have no id bytes), no ids
to no bytes; unknown
ids raise; other columns are kept or ignored, never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import batches_by_bytes, ship

#: Words and segments up to so many bytes go through the one-contraction-a-step query.
SHORT = 64
#: Bytes of new pieces in one recursive query, ids in one decoding query, distinct pieces and units a task remembers.
QUERY_BYTES, QUERY_IDS, PIECES, UNITS = 1 << 18, 1 << 18, 600_000, 200_000

#: Fixed value: a pattern all of whose pieces start at a single space that stands between two other characters.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHORT_SQL = """
WITH RECURSIVE bpe(w, pos, tok, npos, ntok, live) AS (
  SELECT w, pos, tok, npos, ntok, true FROM seed
  UNION ALL
  (WITH pair AS (SELECT b.*, rank FROM bpe b LEFT JOIN merges ON l = tok AND r = ntok WHERE live),
        best AS (SELECT w, min(rank::BIGINT * 1048576 + pos) AS low, arg_min(npos, rank::BIGINT * 1048576 + pos) AS second
                 FROM pair GROUP BY w),
        word AS (SELECT pair.*, low, second, low % 1048576 AS place, low // 1048576 AS merged FROM pair JOIN best USING (w)),
        after AS (SELECT w, npos AS after_pos, ntok AS after_tok FROM word WHERE pos = second)
   SELECT word.w, pos,
          CASE WHEN pos = place THEN merged ELSE tok END,
          CASE WHEN pos = place THEN after_pos ELSE npos END,
          CASE WHEN pos = place THEN after_tok WHEN npos = place THEN merged ELSE ntok END,
          low IS NOT NULL
   FROM word LEFT JOIN after USING (w) WHERE pos IS DISTINCT FROM second))
SELECT w, pos, tok FROM bpe WHERE NOT live ORDER BY w, pos
"""

_LONG_SQL = """
WITH RECURSIVE bpe(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM seed
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN best ELSE tok END, best IS NOT NULL
  FROM (
    SELECT *, lag(hit, 1, false) OVER word AS gone
    FROM (
      SELECT t.*, turn AND k <= coalesce(min(CASE WHEN x.rank < best OR y.rank < best THEN k END)
               OVER (word ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), k) AS hit
      FROM (
        SELECT *, CASE WHEN lag(turn, 2, false) OVER word THEN best ELSE lag(tok) OVER word END AS before,
               lead(tok, 2) OVER word AS behind
        FROM (
          SELECT *, coalesce(rank = best AND (k - coalesce(max(CASE WHEN rank = best THEN NULL ELSE k END)
                                              OVER (word ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1, false) AS turn
          FROM (
            SELECT p.*, rank, safe, row_number() OVER word AS k,
                   min(rank) OVER (word ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best
            FROM (SELECT *, lead(tok) OVER word AS ntok FROM bpe WHERE live WINDOW word AS (PARTITION BY w ORDER BY pos)) p
            LEFT JOIN merges ON l = tok AND r = ntok
            WINDOW word AS (PARTITION BY w ORDER BY pos))
          WINDOW word AS (PARTITION BY w ORDER BY pos))
        WINDOW word AS (PARTITION BY w ORDER BY pos)) t
      LEFT JOIN merges x ON turn AND NOT t.safe AND x.l = before AND x.r = best
      LEFT JOIN merges y ON turn AND NOT t.safe AND y.l = best AND y.r = behind
      WINDOW word AS (PARTITION BY w ORDER BY pos))
    WINDOW word AS (PARTITION BY w ORDER BY pos))
  WHERE NOT gone)
SELECT w, pos, tok FROM bpe WHERE NOT live ORDER BY w, pos
"""

_DECODE_SQL = """
SELECT d, string_agg(chars, '' ORDER BY pos) AS chars
FROM (SELECT d, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM coded) LEFT JOIN vocab USING (tok)
GROUP BY d ORDER BY d
"""


class Numbering(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 for each i, end to end."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)


class Lists:
    """Lists of ids end to end."""

    def __init__(self):
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.starts[which + 1] - self.starts[which]
        return self.flat[spread(self.starts[which], lengths)], lengths


class Codec:
    """The merge table and vocabulary of one rank file in a DuckDB database of this process."""

    def __init__(self, rank_file: bytes, pattern: str):
        # \s and \S of the pattern mean Unicode white space, as regex has it.
        self.pattern = regex.compile(pattern)
        #: Texts are cut into units first; under another pattern, into its pieces alone.
        self.by_units = pattern == SPACE_LED
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.db.execute("SET enable_progress_bar = false")
        self.pieces, self.piece_ids = Numbering(), Lists()
        #: Units by their string behind the leading space; those without one by a tuple of their string.
        self.units, self.unit_ids = Numbering(), Lists()
        self.tables: set[str] = set()
        #: Proper beginnings of tokens, made when the first long word comes.
        self.heads: set[bytes] = set()

    def _need(self, name: str) -> None:
        """Make the merge table or the vocabulary when it is first used."""
        if name not in self.tables:
            self.tables.add(name)
            getattr(self, f"_make_{name}")()

    def _make_merges(self) -> None:
        rows = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    rows.append((left, right, rank))
        left, right, rank = (np.array(x, np.int32) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int32)] * 3
        # A merged token is safe if it is no part of a token of lower rank.
        unsafe = np.union1d(left[rank < left], right[rank < right])
        self._put("m", pa.table({"l": left, "r": right, "rank": rank, "safe": ~np.isin(rank, unsafe)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")

    def _make_vocab(self) -> None:
        self._put(
            "v",
            pa.table(
                {
                    "tok": pa.array(list(self.ranks.values()), pa.int32()),
                    "chars": [t.decode("latin-1") for t in self.ranks],  # one character a byte
                }
            ),
        )
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")

    def _put(self, name: str, data: pa.Table) -> None:
        self.db.register(name, data)

    def _contract(self, words: list[bytes], long: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of each word's ids."""
        self._need("merges")
        lengths = np.array([len(x) for x in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(lengths)
        w = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(flat)) - np.repeat(stops - lengths, lengths)
        tok = self.bytes_of[flat]
        last = np.zeros(len(flat), bool)
        last[stops - 1] = True
        npos, ntok = np.where(last, -1, pos + 1), np.where(last, -1, np.append(tok[1:], -1))
        columns = {"w": w, "pos": pos, "tok": tok, "npos": npos, "ntok": ntok}
        self._put("seed", pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}))
        out = self.db.sql(_LONG_SQL if long else _SHORT_SQL).fetchnumpy()
        return np.asarray(out["tok"], np.uint32), np.bincount(out["w"], minlength=len(words))

    def _segments(self, word: bytes) -> list[bytes]:
        """A long word, cut wherever no token that occurs in it reaches across. Every contraction makes a token that
        stands in the word, so none crosses such a place, and what lies between is contracted on its own."""
        if not self.heads:
            self.heads = {t[:n] for t in self.ranks for n in range(1, len(t))}
        heads, ranks, out, begin, reach = self.heads, self.ranks, [], 0, 0
        for i in range(len(word)):
            if i > begin and reach <= i:
                out.append(word[begin:i])
                begin = i
            stop = i + 1
            while stop < len(word) and word[i:stop] in heads:
                stop += 1
                if stop > reach and word[i:stop] in ranks:
                    reach = stop
        return [*out, word[begin:]]

    def _learn_pieces(self) -> None:
        """Ids of the pieces numbered since the last call, contracted in bounded recursive queries."""
        raw = [x.encode("utf-8", "replace") for x in islice(self.pieces, len(self.piece_ids), None)]
        whole = [self.ranks.get(x) for x in raw]
        # Each piece's segments: a token stands for itself, other pieces are contracted.
        segments = [[x] if rank is not None or len(x) <= SHORT else self._segments(x) for x, rank in zip(raw, whole, strict=True)]
        flat_segments = [x for some in segments for x in some]
        of_piece = np.repeat(np.arange(len(raw)), [len(x) for x in segments])
        ids_of = np.array([-1 if r is None else r for r in whole], np.int64)
        direct = np.flatnonzero(ids_of[of_piece] >= 0)
        done = [(direct, ids_of[of_piece[direct]].astype(np.uint32), np.ones(len(direct), np.int64))]
        for long in (False, True):
            todo, size = [], 0
            rest = [int(i) for i in np.flatnonzero(ids_of[of_piece] < 0) if (len(flat_segments[i]) > SHORT) == long]
            for n, i in enumerate(rest):
                todo.append(i)
                size += len(flat_segments[i])
                if size >= QUERY_BYTES or n == len(rest) - 1:
                    done.append((np.array(todo, np.int64), *self._contract([flat_segments[j] for j in todo], long)))
                    todo, size = [], 0
        lengths = np.zeros(len(flat_segments), np.int64)
        for index, _, n in done:
            lengths[index] = n
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.uint32)
        for index, ids, n in done:
            flat[spread(starts[index], n)] = ids
        self.piece_ids.extend(flat, np.bincount(of_piece, weights=lengths, minlength=len(raw)).astype(np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's ids."""
        if len(self.pieces) > PIECES:
            self.pieces, self.piece_ids = Numbering(), Lists()
        if len(self.units) > UNITS:
            self.units, self.unit_ids = Numbering(), Lists()
        codes: list[int] = []
        stops: list[int] = []
        number = self.units.__getitem__ if self.by_units else self.pieces.__getitem__
        cut = split_units if self.by_units else self.pattern.findall
        for text in texts:
            if text:
                codes += map(number, cut(text))
            stops.append(len(codes))
        if not self.by_units:
            self._learn_pieces()
        elif len(self.units) > len(self.unit_ids):
            piece, found, counts = self.pieces.__getitem__, [], []
            findall = self.pattern.findall
            for unit in islice(self.units, len(self.unit_ids), None):
                pieces = findall(unit[0] if type(unit) is tuple else " " + unit)
                found += map(piece, pieces)
                counts.append(len(pieces))
            self._learn_pieces()
            flat, lengths = self.piece_ids.take(np.array(found, np.int64))
            upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts, dtype=np.int64)]
            self.unit_ids.extend(flat, np.diff(upto, prepend=0))
        flat, lengths = (self.unit_ids if self.by_units else self.piece_ids).take(np.array(codes, np.int64))
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.array(stops, np.int64)]
        return flat, np.diff(upto, prepend=0)

    def decode(self, ids: pa.Array) -> list[bytes | None]:
        """The bytes of each list of ids; null for null."""
        self._need("vocab")
        out: list[bytes | None] = [None if null else b"" for null in ids.is_null().to_pylist()]
        lengths = np.asarray(list_lengths(ids), np.int64)
        start = 0
        while start < len(lengths):
            n = max(1, int(np.searchsorted(np.cumsum(lengths[start:]), QUERY_IDS, side="right")))
            part = ids.slice(start, n)
            self._put("coded", pa.table({"d": np.arange(len(part)), "ids": part}))
            got = self.db.sql(_DECODE_SQL).to_arrow_table()
            for d, chars in zip(got["d"].to_pylist(), got["chars"].to_pylist(), strict=True):
                if d is not None and out[start + d] is not None:
                    out[start + d] = chars.encode("latin-1")
            start += n
        return out


def list_lengths(ids: pa.Array) -> pa.Array:
    return pc.fill_null(pc.list_value_length(ids), 0)


_BESIDE_WHITE = re.compile(r" \s|\s ")
_CUT = regex.compile(r"(?<=\S)(?= \S)")


def split_units(text: str) -> list[str | tuple[str]]:
    """Cuts before single spaces that stand between two characters which are no white space.

    No piece of the pattern crosses such a place (a space begins a piece there), so units are split into pieces
    one by one and repeated units are split once. A string stands for itself behind a space, a tuple for its string.
    """
    if _BESIDE_WHITE.search(text):
        return [(u,) for u in _CUT.split(text)]
    first, *rest = text.split(" ")
    return [(first,), *rest]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a process and rank file: tasks that follow in the same worker reuse its tables."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _id_lists(coder: Codec, texts: pa.Array) -> pa.Array:
    flat, counts = coder.encode(texts.to_pylist())
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>) for every row; ``rank_file`` holds lines of base64 token and rank."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)  # under a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            for part in batches_by_bytes(batch, "text", 2 << 20):
                ids = _id_lists(coder, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids], names=["key", "ids"])

    schema = f"key {kept.schema['key'].dataType.simpleString()}, ids array<int>"
    return kept.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def decode(coded: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ids_bytes, decoded) for every row of ids: the ids as little-endian unsigned 32-bit integers, and the
    bytes they stand for (bytes, as ids may cut a character)."""
    ship(coded.sparkSession)
    kept = coded.select(F.col(id_col).alias("key"), F.col(ids_col).cast("array<int>").alias("ids"))
    shared = coded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            yield from _decoded(coder, batch.column("key"), batch.column("ids"))

    schema = f"key {kept.schema['key'].dataType.simpleString()}, ids_bytes binary, decoded binary"
    out = kept.mapInArrow(run, schema)
    return out.select(F.col("key").alias(id_col), "ids_bytes", "decoded")


def _decoded(coder: Codec, keys: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """(key, ids_bytes, decoded) batches of lists of ids, some rows at a time."""
    for start in range(0, len(ids), 500):
        part = ids.slice(start, 500)
        lengths = np.asarray(list_lengths(part), np.int64)
        raw, stops = np.asarray(part.flatten()).astype("<u4").tobytes(), 4 * np.cumsum(lengths)
        bytes_of = [raw[e - 4 * n : e] for e, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
        columns = [keys.slice(start, 500), pa.array(bytes_of, pa.binary()), pa.array(coder.decode(part), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "ids_bytes", "decoded"])


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` returns for ``encode``'s rows, in one pass: a task then needs one Python worker instead of two
    in a row, each with its own database, and the ids need not go back and forth. Decoding reads the ids alone."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            for part in batches_by_bytes(batch, "text", 2 << 20):
                yield from _decoded(coder, part.column("key"), _id_lists(coder, part.column("text")))

    schema = f"key {kept.schema['key'].dataType.simpleString()}, ids_bytes binary, decoded binary"
    out = kept.mapInArrow(run, schema)
    return out.select(F.col("key").alias(id_col), "ids_bytes", "decoded")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 per decoded row."""
    return decoded.select(
        F.col(id_col),
        F.expr("cast(octet_length(ids_bytes) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
