"""Operator 8 on near-miss, dual and unknown notices, and its scan against plain windows and sets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from pitloom.llm import licence_scan as scan
from pitloom.llm.common import words_of

TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()

FOUNDATION = "as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."
NOTICES = [
    (["agpl"], "Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License " + FOUNDATION),
    (["gpl"], "Foo is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License " + FOUNDATION),
    (["lgpl"], "Foo is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public License " + FOUNDATION),
    (["cc-by-nd"], "This article is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    (["cc-by-nd"], "Content is licensed under CC BY-ND 4.0 unless noted."),
    (["cc-by"], "Content is licensed under CC BY 4.0 unless noted."),
    (["mit", "apache"], "SPDX-License-Identifier: MIT OR Apache-2.0"),
    (["mit", "unknown"], "SPDX-License-Identifier: MIT OR Zlib"),
    (["apache", "mit"], "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    (["mit"], 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
              "MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    (["isc"], "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the "
              "above\ncopyright notice and this permission notice appear in all copies."),
    (["bsd"], "3. Neither the name of the University nor the names of its contributors\nmay be used to endorse or promote products derived from "
              "this software\nwithout specific prior written permission."),
    (["unknown"], "This program is free software: you can redistribute it and/or modify it under the terms of the Frobnitz Community License as "
                  "published by the Frobnitz Foundation."),
    (["unknown"], "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0."),
    (["unknown"], "Released under the Zlib License."),
    ([], "The committee said that a license to fish was required for every person on the boat, and that the terms of the agreement were public."),
    ([], "und " * 500),
    ([], "xqzkw " * 500 + "\n" + "vvbnm"),
]


@pytest.fixture(scope="module")
def model():
    lines = []
    for text in TEXTS:
        some = [x for x in (text or "").split("\n") if x.strip()]
        lines += [w for x in some[:: max(1, len(some) // 6)][:6] if (w := words_of(x[:2000]))]
    return scan.train(lines)


def test_families_of_near_miss_and_dual_notices(model):
    wrong = [(want, got, text) for want, text in NOTICES if (got := [x[1] for x in model.classify([text])[0]]) != want]
    assert not wrong


def test_scores_of_stretches_equal_those_of_their_words_alone(model):
    rng = random.Random(3)
    words = [w for text in TEXTS[:20] for w in words_of(text)[:80]] + [b"und"] * 40 + words_of("MIT License MIT MIT Zlib Zlib xqzkw xqzkw")
    words += words_of(" ".join(text for _, text in NOTICES))
    codes = model._codes(words)
    spans = [(a, rng.randint(a + 1, min(a + 60, len(words)))) for a in (rng.randrange(len(words)) for _ in range(400))]
    spans += [(len(words) - 1, len(words)), (0, len(words))]
    plain = np.concatenate([model.probabilities([model.features(codes[a:b])]) for a, b in spans])
    assert np.allclose(model.laid_out(codes)(spans), plain, atol=1e-4)


def test_template_stretches_match_plain_sets():
    rng = random.Random(8)
    lines = [words_of(x) for some in scan.TEMPLATES.values() for x in some]
    prose = [w for text in TEXTS[:5] for w in words_of(text)][:400]
    for _ in range(60):
        words: list[bytes] = []
        for _ in range(rng.randint(1, 4)):
            piece = list(rng.choice(lines))
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = rng.choice(prose)
            words += rng.choices(prose, k=rng.randint(0, 20)) + piece
        codes = np.array([scan._WORDS.get(w, 0) for w in words], np.int64)
        found = scan.template_hits(codes, np.zeros(len(codes), np.int64)).get(0, {})
        for i, (_, length, shape) in enumerate(scan._LINES):
            size = len(next(iter(shape)))
            starts = [(p, tuple(words[p : p + size])) for p in range(len(words) - size + 1)]
            held = [{g for p, g in starts if a <= p < a + 2 * length and g in shape} for a in range(len(words))]
            spans = list(scan.stretches(found.get(i, []), i))
            assert bool(spans) == any(len(h) >= scan.SHARED * len(shape) for h in held)
            for a, b, n in spans:
                assert n == len({g for p, g in starts if a <= p and p + size <= b and g in shape}) >= scan.SHARED * len(shape)


def test_sample_is_the_same_at_any_layout_and_bounded(spark, monkeypatch):
    got = []
    monkeypatch.setattr(scan, "train", lambda lines: got.append(lines))
    rows = [(i % 5000 if i % 3 else 7, f"text {i}\nline two {i}", "q") for i in range(6000)]  # a third has one id
    rows += [(None, "null id", "q"), (9, None, "q"), (10, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    for parts in (1, 7):
        scan.fit(df.repartition(parts), sample=50)
    assert got[0] == got[1] and 0 < len(got[0]) <= 50 * scan.SAMPLE_LINES
