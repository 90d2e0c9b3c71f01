"""Operators of pitloom.llm on small fixtures: brute force, round trips, and the defined edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import time
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from pitloom.llm import (
    byte_bpe,
    chat_windows,
    dart_minhash,
    decontamination,
    licence_scan,
    quality_cnn,
    quality_outliers,
    repair_shards,
    revisits,
    sharding,
)
from pitloom.llm.common import words_of
from pitloom.llm.queries import ORACLE, QUERIES, RANKS, WORD_BPE, rank_file

SF = "/root/testdata/sf0.001"
LONG = "a" * 3000 + " " + "xyz " * 2000
ODD = [None, "", "  \n\t ", "a", "é ́a\x85b\x1cc  d\n\n e", "</s>[INST] <|turn|> <\\|end|>", LONG, LONG]
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("shard", T.IntegerType()),
     T.StructField("n_words", T.LongType()), T.StructField("x0", T.LongType()), T.StructField("class", T.LongType())]
)


@pytest.fixture(scope="module")
def docs(spark):
    """Sample documents, odd texts, repeated rows, null ids and languages, and columns whose names clash."""
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en" if i % 3 else None, "s", "q", 1, 2, 3, 4) for i, t in enumerate(real + ODD)]
    rows += [rows[3], rows[3], (None, real[5], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def brute_classes(texts: dict[int, str], threshold: float = 0.8) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        n = min(5, len(w))
        sets[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else Counter()
    lead = {i: i for i in texts}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        common = sum((sets[a] & sets[b]).values())
        whole = sum((sets[a] | sets[b]).values())
        if texts[a] == texts[b] or (whole and common / whole >= threshold):
            lead[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    e = np.unique(dart_minhash.mix64(np.arange(400, dtype=np.uint64)))
    a = rng.integers(1, 4, 400).astype(float)
    b = a + np.where(np.arange(400) > 300, 0.5, 0)
    b[:60] = 0
    owner = np.r_[np.zeros(400, int), np.ones(340, int)]
    s = dart_minhash.signatures(np.r_[e, e[60:]], np.r_[a, b[60:]], owner, 3, k=4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert (s[2] == np.uint64(2**64 - 1)).all()


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(60):  # one template with few to many words changed: similarities around the threshold
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    texts |= {100: texts[4], 101: texts[4].upper(), 102: "one two", 103: "one  two", 104: "", 105: "", 106: "!!"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    kept = [r.doc_id for r in dart_minhash.drop_near_duplicates(df).collect()]
    assert sorted(kept) == sorted(set(brute_classes(texts).values()))


def test_near_duplicates_edge_cases(spark, docs):
    got = dart_minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert [r.class_id for r in got if r.doc_id is None] == [5]
    kept = dart_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and None not in ids and 60 in ids
    assert dart_minhash.near_duplicates(empty(spark, docs)).count() == 0


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_long_words_in_few_steps():
    codec, enc = byte_bpe.Codec(rank_file(), public_tokenizers.PATTERN), _tiktoken()
    assert codec.by_units
    rng = random.Random(4)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    texts = [letters, "a" * 30_000, "ab" * 30_000, "=" * 30_000, "".join(rng.choices("0123456789", k=3000)), "".join(rng.choices("etao", k=5000))]
    began = time.monotonic()
    flat, counts = codec.encode(texts)
    assert time.monotonic() - began < 60
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(t) for t in texts]


def test_byte_bpe_long_words_of_any_ranks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SHORT", 0)
    rng = random.Random(5)
    for _ in range(6):  # ranks in random order: a later token may be part of one of lower rank
        tokens = [a for n in (2, 3, 4) for a in map(bytes, itertools.product(b"abc", repeat=n))]
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate([bytes([i]) for i in range(256)] + tokens[: rng.randint(10, len(tokens))])}
        lines = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
        enc = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        codec = byte_bpe.Codec(lines, r"\w+")
        texts = ["".join(rng.choices("abcd"[: rng.randint(2, 4)], k=rng.randint(1, 90))) for _ in range(150)]
        flat, counts = codec.encode(texts)
        assert not codec.by_units
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(t) for t in texts]


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, docs):
    enc, ranks, pattern = _tiktoken(), rank_file(), public_tokenizers.PATTERN
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks, pattern)
    got = Counter((tuple(np.frombuffer(r.ids_bytes, "<u4").tolist()), bytes(r.decoded)) for r in decoded.collect())
    want = Counter((tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert byte_bpe.round_trip(docs, ranks, pattern).exceptAll(decoded).isEmpty()
    assert decoded.exceptAll(byte_bpe.round_trip(docs, ranks, pattern)).isEmpty()
    assert byte_bpe.round_trip(empty(spark, docs), ranks, pattern).count() == 0
    for r in byte_bpe.digests(decoded).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (r.ids_sha256, r.n_tokens) == (hashlib.sha256(raw).hexdigest(), len(raw) // 4)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode(empty(spark, docs), ranks, pattern).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(null, ranks, pattern).collect()} == {1: None, 2: b""}


def test_byte_bpe_odd_pieces():
    codec, enc = byte_bpe.Codec(rank_file(), public_tokenizers.PATTERN), _tiktoken()
    rng = random.Random(5)
    texts = ["a  b", " a", "a ", "　 　x", "don't 'S 12", "!!!" * 200, "é" * 300 + "💩" * 90, " " * 900,
             "".join(rng.choices("abcdefgh", k=700)), "ab" * 900, "ß x y"]
    texts += ["".join(rng.choices("ab \n\t'sé1.", k=60)) for _ in range(200)]
    flat, counts = codec.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(t) for t in texts]


def brute_hits(text, items, n=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = word.findall((text or "").translate(lower))
    hit, found = set(), set()
    for item, other in items:
        w = word.findall((other or "").translate(lower))
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination_matches_brute_force_in_blocks_too(spark, docs):
    items = [(1, "Xyz xyz XYZ"), (2, None), (3, ""), (None, "a"), (1, "d e")]
    real = docs.filter("doc_id = 7").first().text.split()
    items += [(10, " ".join(real[3:40])), (11, " ".join(real[20:33]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {r.doc_id: brute_hits(r.text, items) for r in docs.collect()}
    keyed = docs.withColumnRenamed("doc_id", "key")
    for size in (1 << 20, 30):
        got = decontamination.verdict(decontamination.find_hits(keyed, benchmark, block_bytes=size)).collect()
        assert {r.key: (r.n_words, r.n_hit, r["items"]) for r in got} == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    clean = {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert {r.doc_id for r in kept.collect()} == clean
    cut = decontamination.decontaminate(docs, benchmark, action="spans").filter("doc_id = 7").first().text
    assert brute_hits(cut, items)[1] == 0 and cut.split()[:3] == real[:3]
    assert decontamination.find_hits(empty(spark, keyed), benchmark).count() == 0
    assert decontamination.decontaminate(docs, empty(spark, benchmark)).count() == docs.count()


def test_decontaminate_drops_the_same_documents_in_blocks(spark, docs):
    benchmark = spark.createDataFrame(
        [("a", "w " * 40), ("b", "one two three"), (None, "four five"), ("c", "one two three"), ("d", None), ("e", "w " * 13 + "x")],
        "item_id string, text string",
    )
    rows = [(1, "w " * 60), (2, "One two, three."), (3, None), (4, "four five " + "z " * 60), (5, "four five"), (5, "four five"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))
    whole = decontamination.decontaminate(df, benchmark)
    assert whole.columns == df.columns and sorted(r.doc_id for r in whole.collect()) == [3, 4, 6]
    parts = decontamination.decontaminate(df, benchmark, block_bytes=1)
    assert sorted(r.doc_id for r in parts.collect()) == [3, 4, 6]
    cut = decontamination.decontaminate(df, benchmark, action="spans", block_bytes=1)
    assert {r.doc_id: (r.text or "").split() for r in cut.collect()}[4] == ["z"] * 60


def test_window_set_holds_each_distinct_window_once_and_is_kept():
    items = [("a", "w " * 5000), ("b", "w " * 20), (None, "w " * 13), ("a", "w " * 14), ("s", "x y"), ("t", "x y")]
    made = decontamination.WindowSet(items)
    assert [(t[0], len(t[1])) for t in made.tables] == [(2, 1), (13, 1)]
    ids = np.array([made.ids[w] for w in (b"w",) * 13 + (b"x", b"y")])
    assert sorted((p, n, sorted(set(o))) for p, n, o in made.hits(ids, np.array([15]))) == [(0, 13, ["a", "b"]), (13, 2, ["s", "t"])]
    assert decontamination.window_set("k", items, 13) is decontamination.window_set("k", [], 13)


def test_decontamination_keeps_every_row_for_any_number_of_blocks(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (1, f"{b} tail"), (1, a), (None, b), (None, c), (None, None), (2, f"{c} {a}"), (2, "plain")]
    keyed = spark.createDataFrame(rows, "key long, text string").repartition(3)
    items = [(7, a), (8, b), (9, "plain")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((k, *brute_hits(t, items)) for k, t in rows), key=repr)
    for size in (1 << 20, 30):
        got = decontamination.verdict(decontamination.find_hits(keyed, benchmark, block_bytes=size)).collect()
        assert sorted(((r.key, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want


def test_shards_are_contiguous_and_balanced(spark, docs):
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    for shard, group in itertools.groupby(rows, key=lambda r: r.shard):
        assert [r.slot for r in group] == list(range(sum(r.shard == shard for r in rows)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(4):
        assert abs(sum(r.size for r in rows if r.shard == s) - total / 4) <= 2 * largest
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    assert sharding.assign_shards(empty(spark, docs)).count() == 0
    same = spark.createDataFrame([(1, "x")] * 40, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.assign_shards(same, 4).collect()) == sorted(list(range(10)) * 4)


def test_chat_windows_read_back(spark):
    marks = ["<|turn|>", "<|end|>", "<\\|end|>", "<\\\\|x", "</s>[INST] ok [/INST]", "a\\nb", "\\", "", "<", "|turn|>"]
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], m * (1 + 40 * (i % 3))) for i, m in enumerate(marks)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, None, "x"), (3, 0, "a\nb\\n", "t" * 5000)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 9) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat_windows.windows(df, span=120, history=60).cache()
    got = {r.conv_id: r for r in chat_windows.read_back(made).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in group]
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in made.filter("conv.id = 4").collect():  # no window beyond span and history, in tokens
        assert len(w.formatted) / chat_windows.BYTES_A_TOKEN <= 120 + 60
        assert w.window == 0 or w.n_repeated > 0
    assert all(w.formatted.startswith("<|turn|>system\n") for w in made.filter("conv.id = 1").collect())
    assert chat_windows.read_back(chat_windows.windows(empty(spark, df))).count() == 0


def test_repair_shards_equal_the_library(spark, docs):
    definition = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    whole = Tokenizer.from_str(definition)
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = repair_shards.round_trip(docs, definition).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert repair_shards.round_trip(empty(spark, docs), definition).count() == 0


def test_repair_shards_read_special_strings_as_the_library_does(spark):
    definition = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    whole = Tokenizer.from_str(definition)  # as loaded
    e = repair_shards.Encoder(definition)
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "'ll", "12", " ", "\n", "\x1c", "\x01", "é", "́"]
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|endoftext|>"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(2000)]
    flat, counts = e.encode(texts)
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [3306, 49407, 1002]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    df = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in repair_shards.round_trip(df, definition).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for i, w in enumerate(want[:40])}


def test_repair_random_access():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 60, 80)
    ids = rng.choice([5, 6, 7, 9], int(counts.sum()), p=[0.6, 0.2, 0.1, 0.1]).astype(np.uint32)
    raw = repair_shards.pack([None, *range(79)], ids, counts)
    shard = repair_shards.Shard(raw)
    assert len(shard.rules) > 3 and len(shard.symbols) < len(ids) and shard.doc_ids[0] is None
    ends = np.cumsum(counts)
    for i, (e, n) in enumerate(zip(ends, counts, strict=True)):
        assert np.array_equal(shard.document(i), ids[e - n : e])
        assert np.array_equal(shard.document(i, 3, 11), ids[e - n : e][3:11])
    assert np.array_equal(shard.expand(shard.symbols), ids)
    with pytest.raises(ValueError):
        repair_shards.Shard(b"no" + raw[2:])


def test_repair_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 5000, 256).astype(np.uint32)
    ids, counts = np.tile(one, 200), np.full(200, 256)
    symbols, ends, rules = repair_shards.compress(ids, counts, 5000)
    keys = Counter()
    for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
        keys.update(zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist(), strict=True))
    assert len(rules) < repair_shards.RULES and max(keys.values(), default=0) < repair_shards.MIN_COUNT
    assert len(symbols) <= 2 * 200  # near one symbol a copy
    shard = repair_shards.Shard(repair_shards.pack(list(range(200)), ids, counts))
    assert np.array_equal(shard.expand(shard.symbols), ids)
    assert np.array_equal(shard.document(7, 100, 180), one[100:180])


def test_encoder_marks_and_white_space():
    definition = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    e = repair_shards.Encoder(definition)
    texts = ["p\x01q \x01 \x01\x01", "a\x85b\x1cc\x1fd", "<|endoftext|> x", "I'LL 12's", "é ́a İ ΣΑΣ", "﻿z　y", None, ""]
    flat, counts = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_encoder_pieces_equal_the_library_for_any_characters():
    definition = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    whole, e = Tokenizer.from_str(definition), repair_shards.Encoder(definition)
    assert e.cut is not None
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "'S", "''s", "12", "½", "ª", "ǅ", "İ", "ẞ", "É", "é", " ", "\n", "\r\n", "\x0b"]
    parts += ["\x1c", "\x85", "\xa0", "\u3000", "\u200b", "\x00", "\x01", "Ⱥ", "</w>", "<", "/", "w", ">", "中文", "🙂", "ʰ", "´", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(rng.randint(1, rng.choice([0x2FF, 0xD7FF]))) for _ in range(40)) for _ in range(1500)]
    texts += [f"x{chr(c)}Y {chr(c)} {chr(c)}1" for c in range(1, 0x300)] + [None, "", "é" * 70_000]
    flat, counts = e.encode(texts)
    want = [x.ids for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    other = json.loads(definition)
    other["normalizer"] = None  # another kind: words are read as wholes
    plain = repair_shards.Encoder(json.dumps(other))
    flat, counts = plain.encode(["Ab cd", "x1"])
    want = [x.ids for x in plain.tokenizer.encode_batch(["Ab cd", "x1"], add_special_tokens=False)]
    assert plain.cut is None and [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_repair_pair_places():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 50_000).astype(np.uint64))
    chosen = np.sort(rng.choice(keys, 12_000, replace=False))
    at, want = repair_shards.places(chosen, np.concatenate([keys, keys])), np.searchsorted(chosen, np.concatenate([keys, keys]))
    hit = np.isin(np.concatenate([keys, keys]), chosen)
    assert np.array_equal(at, np.where(hit, want, -1))
    assert (repair_shards.places(chosen[:0], keys) == -1).all() and len(repair_shards.places(chosen, keys[:0])) == 0


def test_repair_shards_split_one_hot_doc_id(spark):
    definition = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    df = spark.range(4000).selectExpr(
        "cast(if(id % 4 = 0, null, if(id < 3000, 7, id)) as long) AS doc_id", "concat('word ', id % 900) AS text", "1 AS hash", "2 AS row"
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the table is small: keep its ranges
    try:
        shards = repair_shards.make_shards(df, definition, shard_ids=500).collect()
    finally:
        spark.conf.unset(coalesce)
    assert len({r.part for r in shards}) > 4 and sum(r.n_docs for r in shards) == 4000
    assert all(r.n_ids < 500 + 10 for r in shards)
    got = repair_shards.round_trip(df, definition).collect()
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id or -1) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in itertools.pairwise(ends))
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())


def test_licence_model_finds_families_and_leaves_prose(spark, docs):
    model = licence_scan.fit(docs)
    rng = random.Random(2)
    prose = " ".join(r.text for r in docs.limit(20).collect() if r.text).split()
    right = total = 0
    for family, lines in licence_scan.TEMPLATES.items():
        for line in lines:
            found = model.classify(["\n".join([" ".join(rng.sample(prose, 12)), line, ""])])[0]
            total += 1
            right += [x[1] for x in found if x[0] == 1] == [family]
    assert right >= 0.9 * total
    assert [x[1] for x in model.classify(["Licensed under the Frobnitz License."])[0]] == ["unknown"]
    got = licence_scan.scan(docs, model).collect()
    assert len(got) == docs.count()
    assert all(r.n_paragraphs == 0 and not r.notices for r in got if r.doc_id in (60, 61, 62))
    assert licence_scan.scan(empty(spark, docs), licence_scan.fit(empty(spark, docs))).count() == 0


def test_licence_notices_wrapped_over_lines_and_inside_long_ones(docs):
    model = licence_scan.fit(docs)
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""
    mit = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
    assert [(x[0], x[1]) for x in model.classify([bsd])[0]] == [(0, "bsd")]
    found = [(x[0], x[1]) for x in model.classify([mit])[0]]
    assert (0, "mit") in found and (4, "mit") in found
    prose = [w for r in docs.limit(20).collect() if r.text for w in r.text.split()]
    rng = random.Random(6)
    left, right = (" ".join(rng.choices(prose, k=300)) for _ in range(2))
    for notice, family in (("Licensed under the Mozilla Public License, version 2.0.", "mpl"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa")):
        assert family in [x[1] for x in model.classify([f"{left} {notice} {right}"])[0]]
    twice = model.classify([f"{left}\nAll rights reserved. {right} Released under the\nMIT License."])[0]
    assert {(1, "reserved"), (1, "mit")} <= {(x[0], x[1]) for x in twice}
    short = model.classify(["Licensed under the MIT license.\nLicensed under Frobnitz."])[0]
    assert [(x[0], x[1]) for x in short] == [(0, "mit"), (1, "unknown")]
    alone = [model.classify([x])[0] for x in (bsd, mit, left)]
    assert [[y[:2] for y in x] for x in model.classify([bsd, mit, left])] == [[y[:2] for y in x] for x in alone]
    assert model.scan([mit, None, "a\nb\n \n--\nc"])[1] == [3, 0, 2]


def test_quality_network_learns_and_reads_whole_texts(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    aside = quality_cnn.held_out(F.col("doc_id"))
    net = quality_cnn.fit(d, labels, ~aside)
    scored = d.join(labels, "doc_id").filter(aside).select("quality", quality_cnn.score(F.col("text"), net).alias("s")).collect()
    accuracy = np.mean([(r.s >= quality_cnn.THRESHOLD) == bool(r.quality) for r in scored])
    assert len(scored) > 300 and accuracy > 0.92
    good = [r.s for r in scored if r.quality]
    assert np.mean(np.array(good) >= quality_cnn.THRESHOLD) > 0.95
    text = "Of the inanin. Thonst aonthrein thedtiou anon. " * 400
    alone = net.score([text, None, "", "a", text + "ZZ!! QQ!! " * 800])
    assert np.allclose(alone, [net.score([t])[0] for t in [text, None, "", "a", text + "ZZ!! QQ!! " * 800]], atol=1e-5)
    assert alone[1] == alone[2] and alone[4] != alone[0]


def test_quality_network_without_classes(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality_cnn.fit(docs, none).score(["x"]).tolist() == [0.5]
    assert quality_cnn.fit(docs, one).score([None, "x"]).tolist() == [1.0, 1.0]
    assert docs.select(quality_cnn.score(F.col("text"), quality_cnn.fit(docs, one))).count() == docs.count()


def brute_counts(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_outlier_counts_match_brute_force(spark, docs):
    want = {r.doc_id: brute_counts(r.text) for r in docs.collect()}
    for r in quality_outliers.outlier_report(docs).collect():
        assert tuple(r[c] for c in quality_outliers.COUNTS) == want[r.doc_id]
        n, _, _, _, k = want[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * k > 50 * n)
        assert not (r.base_failed and r.kept)
    kept = quality_outliers.filter_outliers(docs)
    assert kept.columns == docs.columns
    report = {r.doc_id: r.kept for r in quality_outliers.outlier_report(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in report.items() if k}
    assert quality_outliers.outlier_report(empty(spark, docs)).count() == 0
    assert quality_outliers.filter_outliers(empty(spark, docs)).count() == 0


def test_outlier_estimates_resist_contamination(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.randint(80, 400))
        if i % 4 == 0:  # a quarter is junk: robust estimates must not follow it
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en" if i < 590 else None, "a" if i < 590 else "tiny"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_outliers.outlier_report(df).filter("kept").collect()}
    assert kept == {i for i in range(600) if i % 4}


def test_outliers_of_small_groups_are_judged_by_their_own_rows(spark):
    rng = random.Random(9)
    short = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(3000)]
    long = ["".join(rng.choices("abcdefghij", k=rng.randint(24, 34))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(short, k=rng.randint(80, 400))), "en", "a") for i in range(900)]
    for size, lang in ((60, "de"), (130, "fi")):  # words of another length, below and above a hundred rows
        rows += [(len(rows) + i, " ".join(rng.choices(long, k=rng.randint(80, 400))), lang, "a") for i in range(size)]
    lone = len(rows)
    rows += [(lone, " ".join(rng.choices(long, k=200)), "en", "a"), (lone + 1, " ".join(rng.choices(short, k=200)), "xx", "a")]
    words = rng.sample(short, 200)  # half of the words are repeated, which the base rules allow
    rows.append((lone + 2, " ".join(words[:150] + words[:50]), "en", "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dropped = {r.doc_id for r in quality_outliers.outlier_report(df).filter("not kept").collect()}
    assert dropped == {lone, lone + 2}


def test_chi_square_quantile():
    assert abs(quality_outliers.chi2_quantile(0.5) - 3.3567) < 1e-3
    assert abs(quality_outliers.chi2_quantile(0.975) - 11.1433) < 1e-3


def test_revisits_match_oracle_and_brute_force(spark):
    pages = [(i, f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}Ex.org/{i % 5}/?b=1&utm_x=2&a=0#f", None if i % 9 == 0 else f"h{i % 7}") for i in range(300)]
    pages += [(400, None, "x"), (401, "http://ex.org:80/q?x=1", ""), (401, "http://ex.org:80/q?x=1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("at", F.lit("clash"))
    records = revisits.captures(df)
    rows = records.withColumn("canon", revisits.canonical_url(F.col("url"))).collect()
    assert {r.canon for r in rows if r.record_id < 20} <= {f"ex.org/{i}?a=0&b=1" for i in range(5)}
    full = [r for r in rows if r.kind == "response" and r.status == 200 and r.canon is not None]
    want = Counter()
    for r in (r for r in rows if r.kind == "revisit"):
        earlier = [x for x in full if x.canon == r.canon and (x["at"], x.record_id) < (r["at"], r.record_id)]
        hit = max(earlier, key=lambda x: (x["at"], x.record_id), default=None)
        verdict = "orphan"
        if hit is not None:
            pairs = [(r.etag and r.etag.removeprefix("W/"), hit.etag), (r.last_modified, hit.last_modified), (r.digest, hit.digest)]
            same = next((a == b for a, b in pairs if a is not None and b is not None), None)
            verdict = "unverified" if same is None else "resolved" if same else "mismatch"
        want[(r.record_id, hit.record_id if hit else None, verdict)] += 1
    for slices in (512, 7, 1):
        got = revisits.resolve(records, slices)
        assert Counter((r.record_id, r.target_id, r.verdict) for r in got.collect()) == want
    one = got.filter("verdict = 'resolved'").first().merged_headers
    assert one["content-type"] == "text/html" and one["content-length"] != "0" and one["cache-control"].startswith("max-age")
    assert revisits.resolve(empty(spark, records)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    at = [next(i for i, c in enumerate(want.description) if c[0] == x) for x in columns]
    expected = sorted(([r[i] for i in at] for r in want.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == expected


def test_pipeline_stages_keep_columns_and_follow_their_operators(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    current = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, SF).cache()
        assert after.columns == d.columns
        assert after.join(current, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= current.count()
        current = after
    final = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    text = {r.doc_id: r.text for r in current.collect()}
    for r in final.collect():
        assert r.decoded_sha256 == hashlib.sha256((text.pop(r.doc_id) or "").encode()).hexdigest()
    assert not text
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark, d), SF).count() == 0
