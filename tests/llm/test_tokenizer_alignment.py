"""Operator 12 against whole-text encodings and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pitloom.llm import tokenizer_alignment as ta
from pitloom.llm.queries import BYTE_BPE, PIECES, rank_file

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, radix int, n_a string, head long, bundle int"


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path(BYTE_BPE), encoding="utf-8") as file:
        return file.read(), rank_file(public_tokenizers.path(PIECES))


@pytest.fixture(scope="module")
def brute(files):
    a_side = Tokenizer.from_str(files[0])
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_proto=files[1])
    alphabet = ta.byte_alphabet()
    names = {v: k for k, v in a_side.get_vocab().items()}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def encoded(text):
        if not text:
            return [], []
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        raw = (" " + text).encode()
        bytes_a, bytes_b = [bytes(alphabet[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return [], []
        return list(zip(a, map(len, bytes_a), strict=True)), list(zip(b, map(len, bytes_b), strict=True))

    def run(rows):
        per_doc = []
        for doc_id, text in rows:
            a, b = encoded(text)
            links, groups, i, j, end_a, end_b, begin = Counter(), [], 0, 0, 0, 0, (0, 0)
            while i < len(a) and j < len(b):  # walk both sides in step
                links[a[i][0], b[j][0]] += 1
                stop_a, stop_b = end_a + a[i][1], end_b + b[j][1]
                if stop_a <= stop_b:
                    end_a, i = stop_a, i + 1
                if stop_b <= stop_a:
                    end_b, j = stop_b, j + 1
                if end_a == end_b:
                    groups.append((begin, (i, j)))
                    begin = (i, j)
            text_of = ";".join(
                ",".join(str(x) for x, _ in a[p:q]) + "|" + ",".join(str(x) for x, _ in b[r:s]) for (p, r), (q, s) in groups
            )
            per_doc.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
        counts = Counter(pair for d in per_doc for pair in d[4])
        most = Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        rows_out = [
            (d[0], d[1], d[2], d[3], sum(d[4].values()), sum(n for p, n in d[4].items() if counts[p] == most[p[0]]),
             sum(n * counts[p] for p, n in d[4].items()), d[5])
            for d in per_doc
        ]
        return sorted(rows_out, key=str), {(x, y, n, n == most[x]) for (x, y), n in counts.items()}

    return run


@pytest.fixture(scope="module")
def rows(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80).collect()]
    odd = [
        None, "", " ", "  ", "\n", "a", " a", "a ", "a \n ", "two  spaces   here ", "tab\tand\n new\n\nlines", "▁mark", "x▁y z", "<s> <0x41> <unk>",
        "<|endoftext|> plain", "don't we'll I'M", "日本語 の テキスト", "é ́a\x85b\x1cc   d 　e", "🙂🙂 \U0001f9d1‍\U0001f680", "\x00 \x01", "a" * 4000,
        "long " * 3000,
    ]
    texts = real + odd + [real[0], real[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, real[3]), (None, real[4])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "s", "c", 1, "n", 2, 3) for r in rows], SCHEMA)


def results(spark, rows, files):
    docs, pairs = ta.align(frame(spark, rows).repartition(3), *files)
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, docs.collect()), key=str), {tuple(p) for p in pairs.collect()}


def test_equals_whole_texts_and_plain_counts(spark, rows, files, brute):
    assert results(spark, rows, files) == brute(rows)


def test_many_chunks_and_merges(spark, rows, files, brute, monkeypatch):
    """Small chunks and bundles, so that runs are merged level by level (parameters read on the driver)."""
    monkeypatch.setattr(ta, "FAN", 2)
    some = [(k, t) for k, (_, t) in enumerate(rows * 3)]
    docs, _ = ta.align(frame(spark, some).repartition(11), *files)
    assert sorted(map(tuple, docs.collect()), key=str) == brute(some)[0]


def test_empty_table(spark, files):
    docs, pairs = ta.align(frame(spark, []), *files)
    assert docs.collect() == [] and pairs.collect() == []


def test_random_texts_unit_by_unit(files, brute):
    rng = random.Random(6)
    alphabet = " \n\t'aZ9éß漢▁  .-<s>\r\x1f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    coder = ta.Aligner(*files)
    assert coder.parted
    chunk = ta.Chunk(coder)
    chunk.add(list(range(400)), texts)
    got = list(zip(range(400), *(chunk.rows[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")), strict=True))
    want = {r[0]: (*r[:5], r[7]) for r in brute(list(enumerate(texts)))[0]}
    assert got == [want[k] for k in range(400)]


def test_heap_merge_and_highest_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 50, 30)) << 32 | 7 for _ in range(5)]
    counts = [rng.integers(1, 9, len(r)) for r in runs]
    pairs, sums = ta.merge([ta.pack_head(r, c) for r, c in zip(runs, counts, strict=True)])
    want = Counter()
    for r, c in zip(runs, counts, strict=True):
        want.update(dict(zip(r.tolist(), c.tolist(), strict=True)))
    assert dict(zip(pairs.tolist(), sums.tolist(), strict=True)) == want and list(pairs) == sorted(pairs)
    assert ta.best(np.array([1 << 32, 1 << 32 | 1, 2 << 32]), np.array([2, 2, 1])).tolist() == [True, True, True]
    assert ta._sums(np.array([0, 0]), np.array([2**40 + 3, 2**41 + 5]), 1).tolist() == [2**40 + 2**41 + 8]
