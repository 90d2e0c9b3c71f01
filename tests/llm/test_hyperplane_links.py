"""Operator 13 against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pitloom.llm import hyperplane_links as hl

SCHEMA = "vec_id long, embedding array<float>, label int, node long, codes string, piece int, links long, class long"


def brute(rows, similarity=hl.SIMILARITY):
    n = len(rows)
    fit = [
        r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])
        for r in rows
    ]
    linked = [set() for _ in rows]
    arrays = [np.array(r[1], np.float32).astype(np.float64) if f else None for r, f in zip(rows, fit, strict=True)]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(arrays[i]) == len(arrays[j]):
                if arrays[i] @ arrays[j] / (np.linalg.norm(arrays[i]) * np.linalg.norm(arrays[j])) >= similarity:
                    linked[i].add(j)
                    linked[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in linked[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        lead = min(ids) if ids else None
        out.append((rows[i][0], len(linked[i]), lead, rows[i][0] == lead))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    made = []
    for label in (1, 2):
        for _ in range(12):  # groups whose members lie on both sides of the threshold
            centre = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 12))):
                v = centre / np.linalg.norm(centre) + rng.standard_normal(24) * rng.choice([0.01, 0.03, 0.045])
                made.append([len(made), (v * rng.choice([1e-30, 1.0, 1e30])).astype(np.float32).tolist(), label])
    made += [[len(made) + k, list(made[3][1]), 1] for k in range(40)]  # copies
    made += [[1000, list(made[3][1]), 2], [1001, list(made[3][1]), None], [3, list(made[3][1]), 1], [None, list(made[3][1]), 1]]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [None], [float("inf")] * 24, [-0.0] * 24]
    made += [[2000 + k, v, 1] for k, v in enumerate(bad)]
    made += [[3000, [1.0, 0.0], 1], [3001, [1.0, -0.0], 1], [3002, [2.0, 0.0], 1], [None, [5.0] * 24, 9], [None, [5.0] * 24, 9]]
    return made


def test_equals_all_pairs(spark, rows):
    want = brute(rows)
    assert found(hl.near_duplicates(frame(spark, rows).repartition(4))) == want
    assert found(hl.near_duplicates(frame(spark, rows), tables=0)) == want


def test_blocks_of_a_hot_bucket(spark, monkeypatch, rows):
    """A bucket of many blocks, and pieces of work of few pairs at a time, give the same links."""
    monkeypatch.setattr(hl, "BLOCK", 7)
    assert found(hl.near_duplicates(frame(spark, rows), bits=4)) == brute(rows)


def test_empty_table(spark, rows):
    assert found(hl.near_duplicates(frame(spark, []))) == []


def test_misses_are_as_rare_as_stated():
    rng = np.random.default_rng(4)
    bits, similarity = 8, hl.SIMILARITY
    tables = hl.tables_for(bits, similarity, 0.05)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = similarity * a + np.sqrt(1 - similarity**2) * side
    missed = ~(hl.codes(a, bits, tables) == hl.codes(b, bits, tables)).any(axis=1)
    assert missed.mean() < 0.07
    assert hl.tables_for(8, similarity) <= 20 and hl.tables_for(20, similarity) <= 60
