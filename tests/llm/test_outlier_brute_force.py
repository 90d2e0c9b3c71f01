"""Operator 10 against plain Python: colliding window hashes, and the whole estimate in numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pitloom.llm import quality_outliers as q
from tests.llm.test_llm import brute_counts


def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch):
    texts = [None, "", "a b", "a b c", "a b c a b c", "a b c d a b c x a b c", "x y z w v u", "a a a a a", "é b c\né b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for hashed in ("length({w}[i]) * 0L", "cast(ascii({w}[i]) AS bigint) * 1048576"):
        monkeypatch.setattr(q, "_WINDOWS", q._WINDOWS)
        weak = q._WINDOWS.replace("xxhash64({w}[i], {w}[i + 1], {w}[i + 2])", hashed)
        assert weak != q._WINDOWS
        monkeypatch.setattr(q, "_WINDOWS", weak)
        for r in q.with_counts(df).collect():
            assert tuple(r[q._BASE][c] for c in q.COUNTS) == brute_counts(r.text)
        monkeypatch.undo()


def vector(text):
    n_words, chars, symbols, lines, repeated = brute_counts(text)
    n = max(n_words, 1)
    raw = [math.log1p(n_words), math.log(max(chars / n, 1.0)), math.log1p(100 * symbols / n), math.log1p(100 * (repeated + lines) / n)]
    return [math.floor(x * 256 + 0.5) / 256 for x in raw]


def consistency(share):
    k = min(max(math.floor(100 * share + 0.5), 1), 99) / 100
    x = q.chi2_quantile(k)
    return k / (1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(3)))


def plain_estimate(x):
    """Mean and covariance of the rows ``x`` before mixing: concentration steps and one reweighting."""
    floors = np.diag(np.square(q.FLOORS))
    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2) + floors

    def bins():
        gap = x - mean
        d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
        return np.floor(np.log2(d + 2.0**-20) * 64).astype(int)

    def moments(chosen, factor):
        return x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True) * factor + floors

    for _ in range(q.STEPS):
        b = bins()
        before = np.array([(b < v).sum() for v in b])
        chosen = before < q.HALF * len(x)
        mean, cov = moments(chosen, consistency(chosen.sum() / len(x)))
    edge = q.chi2_quantile(0.975)
    tail = math.exp(-edge / 2) * sum((edge / 2) ** j / math.factorial(j) for j in range(3))
    return moments(bins() <= math.floor(math.log2(edge + 2.0**-20) * 64), 0.975 / (1 - tail))


def brute_kept(rows):
    vectors = {i: vector(t) for i, t, *_ in rows}
    groups = {}
    for i, t, lang, source in rows:
        if brute_counts(t)[0]:
            groups.setdefault((lang, source), []).append(i)
    everyone, everything = plain_estimate(np.array([vectors[i] for g in groups.values() for i in g]))
    kept = set()
    for members in groups.values():
        x = np.array([vectors[i] for i in members])
        mean, cov = plain_estimate(x)
        own = len(x) / (len(x) + q.PRIOR)
        gap = mean - everyone
        cov = own * cov + (1 - own) * everything + own * (1 - own) * np.outer(gap, gap)
        away = x - (everyone + own * gap)
        d = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        kept |= {i for i, v in zip(members, d, strict=True) if v <= q.chi2_quantile(1 - q.TAIL)}
    texts = {i: t for i, t, *_ in rows}
    return {i for i in kept if (c := brute_counts(texts[i]))[0] >= 50 and 2 * c[4] <= c[0]}


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_match_a_plain_estimate(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 12))) for _ in range(2000)]
    rows = []
    for i in range(500):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        if i % 7 == 0:
            words = [w + rng.choice(["", "%", "#|", "%%%%%"]) for w in words]
        if i % 11 == 0:
            words = [w * rng.randint(1, 5) for w in words]
        if i % 13 == 0:
            words = words + words[: len(words) // 4]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows.append((i, None if i == 400 else text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b"])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = brute_kept(rows)
    assert 300 < len(want) < 500
    assert {r.doc_id for r in q.outlier_report(df).filter("kept").collect()} == want
    assert {r.doc_id for r in q.filter_outliers(df).collect()} == want
