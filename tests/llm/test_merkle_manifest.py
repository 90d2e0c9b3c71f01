"""Operator 11 against a plain recursive version."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pitloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, n long, digest string, level int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    values = [row[c] for c in mm.FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str], arity: int = 3) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and each leaf's (left, right) siblings by level."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, at in enumerate(place):
            run = at - at % arity
            paths[leaf_no].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
            place[leaf_no] = at // arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs[s] = climb([leaf(r) for r in groups[s]])
    root, over = climb([subs[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], subs[s][1], strict=True):
            steps = path + over[k]
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf({**r, "text": text})
            for a, b in steps:
                node = h(a, node, b)
            out.append((r["doc_id"], leaf(r), subs[s][0], root, h(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "a\nb", "x" * 5000 + "\n" + "é " * 2000, "one line", "\n\n\n"])
    made = [
        {"doc_id": i, "text": text(), "lang": rng.choice([None, "en", "日本"]), "source": "hot" if i % 3 else f"s{i % 7}", "n_chars": i * 7}
        for i in range(120)
    ]
    made += [dict(made[5]), dict(made[5]), {**made[5], "text": "other"}]  # repeated rows, and a repeated id
    made += [{"doc_id": None, "text": "no id\n", "lang": None, "source": None, "n_chars": None}]
    made += [{"doc_id": -4, "text": "lone\n", "lang": "en", "source": "", "n_chars": 1}]
    rng.shuffle(made)
    return made


def frame(spark, rows):
    return spark.createDataFrame([{**r, "tree": "t", "at": 3, "n": 9, "digest": "d", "level": 0} for r in rows], SCHEMA)


def test_equals_plain_trees(spark, rows):
    got = sorted(map(tuple, mm.verified_documents(frame(spark, rows).repartition(5)).collect()), key=str)
    want = brute([dict(r) for r in rows])
    assert got == want
    assert {True, False} == {g[-1] for g in got}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, rows, n):
    some = [dict(r) for r in rows[:n]]
    got = sorted(map(tuple, mm.verified_documents(frame(spark, some)).collect()), key=str)
    assert got == (brute(some) if some else [])


def test_binary_tree_and_its_nodes(spark):
    df = spark.createDataFrame([(i, "g") for i in range(11)], "k long, g string")
    made = mm.build(df, "k", "g", mm.leaf_digest([F.col("k")]), {"k": F.col("k")}, arity=2)
    digests = [h(f"{len(str(i))}:{i}") for i in range(11)]
    top, paths = climb(digests, 2)
    assert made.root == top
    got = {r.k: [(s.left, s.right) for s in r.steps] for r in made.leaves.collect()}
    assert got == {i: paths[i] for i in range(11)}
    assert {r.level: r["count"] for r in made.nodes.groupBy("level").count().collect()} == {0: 11, 1: 6, 2: 3, 3: 2}
    folded = made.leaves.select(mm.fold(F.col("digest"), F.col("steps")).alias("root")).distinct().collect()
    assert [r.root for r in folded] == [top]
