"""Operator 8: licence families of paragraphs by a trained sparse n-gram classifier, confirmed by templates.

A paragraph is a run of consecutive lines that hold a word, so a notice wrapped over lines is one text. A multinomial
logistic regression on sparse word unigrams and bigrams tells licence families, an unknown class (licence notices of no
known family) and ordinary text apart; its probabilities are calibrated by one temperature fitted on examples set aside.

Wherever a paragraph holds ``SHARED`` of a template line's word trigrams within twice that line's length, that stretch is
scored by itself, whatever surrounds it and whatever class wins there; it has the template's family if its calibrated
probability reaches ``SURE``; an SPDX expression is read as one identifier line for each of its ids. What is left of the paragraph is scored by lines and by overlapping windows of ``WINDOW``
words; notices that fail either test are ``unknown``. Notices do not overlap, and each has the line of its first word.

Training examples are made from the template lines below (words dropped, framed by words of the corpus; unknown where
other words stand for the words that name the family) and from paragraphs of a bounded sample: the ``SAMPLE`` documents of lowest hash, ``SAMPLE_LINES`` lines of each, spread
evenly, without those that share a trigram with a template. Everything else runs over every paragraph.

Defined results: null, empty and wordless texts have no paragraphs; an empty table trains on templates alone and gives
no rows; repeated rows are scanned alike; paragraphs of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import WORD_BYTES, batches_by_bytes, materialise, ship, words_of

SAMPLE, SAMPLE_LINES = 1000, 6
VARIANTS, EPOCHS, RATE, SEED = 60, 40, 0.5, 11
#: Least calibrated probability of a family, and least share of a template line's trigrams.
SURE, SHARED = 0.6, 0.6
#: Words of a scored window (every half window one begins); a rest of a line of fewer words beside a notice belongs to it.
WINDOW, REST = 32, 4
NONE, UNKNOWN = "none", "unknown"

# Wording of public licence notices.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Apache License, Version 2.0",
        "Licensed under either of Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "ISC License",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "MIT License",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": (
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Notices of no known family; the blank is filled with made-up names.
UNKNOWN_TEMPLATES = (
    "Licensed under the {} License.",
    "This work is licensed under the {} Public License, version 1.",
    "Released under the {} License.",
    "Distributed under the terms of the {} licence agreement.",
    "SPDX-License-Identifier: LicenseRef-{}",
)
#: Words that name a family: with other words in their place a template line is a notice of an unknown family.
NAMES = frozenset(
    b"affero agpl apache attribution bsd by cc commons creative general gnu gpl isc lesser lgpl mit mozilla mpl nc nd"
    b" noderivatives noncommercial sa sharealike".split()
)
CLASSES = (NONE, UNKNOWN, *TEMPLATES)


#: An SPDX expression, and its operators: each of its ids is read as an identifier line of its own.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[^\n]*")
_OPERATOR = re.compile(r"[ \t]+(?:OR|AND)[ \t]+")


def _spelt_out(text: str) -> str:
    if "SPDX-License-Identifier:" not in text:
        return text
    return _EXPRESSION.sub(lambda m: _OPERATOR.sub(" SPDX-License-Identifier: ", m[0]), text)


_LINE_BYTES = WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]


def paragraphs(text: str | None) -> list[list[tuple[int, list[bytes]]]]:
    """Runs of consecutive lines that hold a word: (line number, words) of each line."""
    out: list[list[tuple[int, list[bytes]]]] = []
    last = -2
    for i, line in enumerate(_spelt_out(text).encode("utf-8", "replace").translate(_LINE_BYTES).split(b"\n") if text else ()):
        if words := line.split():
            if i != last + 1:
                out.append([])
            out[-1].append((i, words))
            last = i
    return out


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(3, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


#: Template lines as (class, words, trigrams), numbers of their words, and the lines that hold a trigram.
_LINES = [(CLASSES.index(f), len(words_of(x)), trigrams(words_of(x))) for f, lines in TEMPLATES.items() for x in lines]
_WORDS = {w: i + 1 for i, w in enumerate(sorted({w for _, _, shape in _LINES for gram in shape for w in gram}))}
_HOLDERS: dict[int, list[int]] = {}
for _line, (_, _, _shape) in enumerate(_LINES):
    for _gram in _shape:
        _code = 0
        for _w in _gram:
            _code = _code * (len(_WORDS) + 1) + _WORDS[_w]
        _HOLDERS.setdefault(_code, []).append(_line)
_GRAM_SIZES = sorted({len(gram) for _, _, shape in _LINES for gram in shape})
_GRAMS = np.array(sorted(_HOLDERS), np.int64)

#: (position, gram) of template trigrams, by template line.
Hits = dict[int, list[tuple[int, int]]]


def template_hits(codes: np.ndarray, owner: np.ndarray) -> dict[int, Hits]:
    """Template trigrams inside the paragraphs of words laid end to end: per paragraph and template line, in order."""
    out: dict[int, Hits] = {}
    codes = np.where(codes <= len(_WORDS), codes, 0)
    for size in _GRAM_SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        grams, whole = np.zeros(n, np.int64), owner[:n] == owner[size - 1 :]
        for k in range(size):
            grams = grams * (len(_WORDS) + 1) + codes[k : k + n]
            whole = whole & (codes[k : k + n] > 0)
        at = np.flatnonzero(whole)
        at = at[_GRAMS[np.minimum(np.searchsorted(_GRAMS, grams[at]), len(_GRAMS) - 1)] == grams[at]]
        for pos, gram, paragraph in zip(at.tolist(), grams[at].tolist(), owner[at].tolist(), strict=True):
            for line in _HOLDERS[gram]:
                out.setdefault(paragraph, {}).setdefault(line, []).append((pos, gram))
    return out


def stretches(hits: list[tuple[int, int]], line: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end, trigrams) of the stretches that hold ``SHARED`` of a template line's trigrams."""
    _, length, shape = _LINES[line]
    size = len(next(iter(shape)))

    def held(i: int) -> tuple[int, int]:
        seen: set[int] = set()
        end = 0
        for pos, gram in hits[i : i + 2 * length]:
            if pos >= hits[i][0] + 2 * length:
                break
            if gram not in seen:
                seen.add(gram)
                end = pos + size
        return len(seen), end

    i = 0
    while i < len(hits):
        count, end = held(i)
        if count < SHARED * len(shape):
            i += 1
            continue
        first, j = i, i + 1
        while j < len(hits) and hits[j][0] < hits[i][0] + length:
            more, other = held(j)
            if more > count or (more == count and other - hits[j][0] < end - hits[first][0]):
                first, count, end = j, more, other
            j += 1
        yield hits[first][0], end, count
        while i < len(hits) and hits[i][0] < end:
            i += 1


def likeness(hits: Hits, family: int, start: int, end: int) -> float:
    """The largest share of a template line's trigrams, for a class, that lie in the words from ``start`` to ``end``."""
    best = 0.0
    for line, found in hits.items():
        if _LINES[line][0] == family:
            shape = _LINES[line][2]
            size = len(next(iter(shape)))
            best = max(best, len({g for pos, g in found if start <= pos and pos + size <= end}) / len(shape))
    return best


def windows(start: int, end: int) -> list[tuple[int, int]]:
    half = WINDOW // 2
    return [(a, min(a + WINDOW, end)) for a in range(start, max(end - half, start + 1), half)]


def apart(candidates: list[tuple]) -> list[tuple]:
    """Of candidates (rank, start, end, ...) those that overlap none of a better rank, by start."""
    starts: list[int] = []
    taken: list[tuple] = []
    for c in sorted(candidates, key=lambda c: (c[0], c[1])):
        i = bisect_right(starts, c[1])
        if (i == 0 or taken[i - 1][2] <= c[1]) and (i == len(taken) or taken[i][1] >= c[2]):
            starts.insert(i, c[1])
            taken.insert(i, c)
    return taken


def _repeats(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(min(1, len(codes)), bool), codes[1:] == codes[:-1]])


class Model:
    """Sparse multinomial logistic regression: vocabulary, weights by n-gram and class, and a temperature.

    The vocabulary holds the words and pairs of two examples or more, so that training meets unknown words too. A word
    that repeats the word before it counts for nothing: a run of one word says no more than the word.
    """

    def __init__(self, examples: list[list[bytes]]):
        self.words = dict(_WORDS)  # words of templates have the least numbers
        holders = Counter(w for e in examples for w in dict.fromkeys(e))
        for w, n in holders.items():
            if n > 1:
                self.words.setdefault(w, len(self.words) + 1)
        self.base = len(self.words) + 1
        pairs = [np.unique(self._pairs(self._codes(e))) for e in examples]
        found, n = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]), return_counts=True)
        self.pairs = found[n > 1]
        self.weights = np.zeros((1 + self.base + len(self.pairs), len(CLASSES)), np.float32)  # row 0: offset
        self.temperature = 1.0

    def _codes(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in words], np.int64)

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        both = (codes[:-1] > 0) & (codes[1:] > 0) & (codes[:-1] != codes[1:])
        return codes[:-1][both] * self.base + codes[1:][both]

    def features(self, codes: np.ndarray) -> np.ndarray:
        """Weight rows of a paragraph: the offset, known words and known pairs."""
        pairs = self._pairs(codes)
        codes = codes[(codes > 0) & ~_repeats(codes)]
        at = np.searchsorted(self.pairs, pairs)
        at = at[(at < len(self.pairs)) & (self.pairs[np.minimum(at, max(0, len(self.pairs) - 1))] == pairs)] if len(self.pairs) else at[:0]
        return np.concatenate([[0], 1 + codes, 1 + self.base + at])

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = self.weights[np.concatenate(rows)]
        sums = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._calibrated(self.logits(rows))

    def _calibrated(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def laid_out(self, codes: np.ndarray) -> Callable[[list[tuple[int, int]]], np.ndarray]:
        """Probabilities of stretches (start, end) of words laid end to end; each depends on its own words only."""
        pairs = self._pairs_at(codes)
        again = _repeats(codes)
        own = np.where((again | (codes == 0))[:, None], np.float32(0), self.weights[1 + codes])
        word_rows = np.concatenate([own, np.zeros((1, len(CLASSES)), np.float32)])
        pair_rows = np.where((pairs >= 0)[:, None], self.weights[1 + self.base + pairs], np.float32(0))
        n_words = np.concatenate([[0], np.cumsum((codes > 0) & ~again)])
        n_pairs = np.concatenate([[0], np.cumsum(pairs >= 0)])

        def score(spans: list[tuple[int, int]]) -> np.ndarray:
            if not spans:
                return np.empty((0, len(CLASSES)))
            at = np.array(spans, np.int64)
            start, end = at[:, 0], at[:, 1]
            sums = self.weights[0] + np.add.reduceat(word_rows, at.ravel(), axis=0)[::2]
            last = np.stack([start, end - 1], axis=1)
            sums = sums + np.where((end - start > 1)[:, None], np.add.reduceat(pair_rows, last.ravel(), axis=0)[::2], 0)
            first = again[start] & (codes[start] > 0)  # repeats a word outside the stretch
            sums = sums + np.where(first[:, None], self.weights[1 + codes[start]], np.float32(0))
            sizes = 1 + first + n_words[end] - n_words[start] + n_pairs[end - 1] - n_pairs[start]
            return self._calibrated(sums / np.sqrt(sizes)[:, None])

        return score

    def _pairs_at(self, codes: np.ndarray) -> np.ndarray:
        """The number of the known pair that begins at each word, or -1."""
        out = np.full(len(codes), -1, np.int64)
        if len(self.pairs):
            both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (codes[:-1] != codes[1:]))
            pairs = codes[both] * self.base + codes[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            out[both] = np.where(self.pairs[at] == pairs, at, -1)
        return out

    def scan(self, texts: list[str | None]) -> tuple[list[list[tuple[int, str, float, float]]], list[int]]:
        """Per text its notices, as ``classify`` gives them, and the number of its paragraphs."""
        found: list[list[tuple[int, str, float, float]]] = [[] for _ in texts]
        counts: list[int] = []
        flat: list[int] = []
        owners: list[int] = []
        lines: list[list[tuple[int, int]]] = []  # (first word, line number) of each paragraph
        ends: list[int] = []
        number = self.words.get
        for t, text in enumerate(texts):
            made = paragraphs(text)
            counts.append(len(made))
            for paragraph in made:
                begins = []
                for line, words in paragraph:
                    begins.append((len(flat), line))
                    flat += [number(w, 0) for w in words]
                owners.append(t)
                lines.append(begins)
                ends.append(len(flat))
        if not flat:
            return found, counts
        codes = np.array(flat, np.int64)
        sizes = np.diff(ends, prepend=0)
        hits = template_hits(codes, np.repeat(np.arange(len(ends)), sizes))
        score = self.laid_out(codes)
        located = [
            (p, line, *span) for p, by_line in sorted(hits.items()) for line, at in by_line.items() for span in stretches(at, line)
        ]
        sure: dict[int, list[tuple]] = {}
        rest: dict[int, list[tuple]] = {}
        for (p, line, a, b, n), chances in zip(located, score([x[2:4] for x in located]), strict=True):
            family, like = _LINES[line][0], n / len(_LINES[line][2])
            if chances.argmax() == family and chances[family] >= SURE:
                sure.setdefault(p, []).append(((-n, -like), a, b, CLASSES[family], float(chances[family]), like))
            else:
                rest.setdefault(p, []).append((-float(chances[1:].sum()), a, b, UNKNOWN, float(chances[1:].sum()), like))
        sure = {p: apart(c) for p, c in sure.items()}
        spans: list[tuple[int, int]] = []
        paragraph_of: list[int] = []
        for p, end in enumerate(ends):
            start = ends[p - 1] if p else 0
            edges = [start, *(x for c in sure.get(p, ()) for x in c[1:3]), end]
            starts = [a for a, _ in lines[p]]
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if a == b:
                    continue
                some = windows(a, b) if p not in sure or b - a >= REST else []
                if len(starts) > 1:
                    first = bisect_right(starts, a) - 1
                    for i in range(first, len(starts)):
                        if starts[i] >= b:
                            break
                        x, y = max(a, starts[i]), min(b, starts[i + 1] if i + 1 < len(starts) else end)
                        if y - x <= WINDOW and (x, y) not in some and (y - x == (starts + [end])[i + 1] - starts[i] or y - x >= REST):
                            some.append((x, y))
                spans += some
                paragraph_of += [p] * len(some)
        chances = score(spans)
        for i in np.flatnonzero(chances.argmax(axis=1) != 0).tolist():
            p, (a, b), q = paragraph_of[i], spans[i], chances[i]
            best = 2 + int(q[2:].argmax())
            like = likeness(hits.get(p, {}), best, a, b)
            known = q.argmax() == best and q[best] >= SURE and like >= SHARED
            chance = float(q[best] if known else q[1:].sum())
            rest.setdefault(p, []).append((-float(q[1:].sum()), a, b, CLASSES[best] if known else UNKNOWN, chance, like))
        for p in sorted(sure.keys() | rest.keys()):
            first = [(-2.0, *c[1:]) for c in sure.get(p, ())]
            starts = [a for a, _ in lines[p]]
            for _, a, _, family, chance, like in apart(first + rest.get(p, [])):
                found[owners[p]].append((lines[p][bisect_right(starts, a) - 1][1], family, chance, like))
        return found, counts

    def classify(self, texts: list[str | None]) -> list[list[tuple[int, str, float, float]]]:
        """Per text: (line number, family or unknown, calibrated probability, template likeness) of its notices."""
        return self.scan(texts)[0]


def train(sample: list[list[bytes]], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """A model from template variants and ordinary paragraphs; deterministic for given paragraphs in given order."""
    rng = np.random.default_rng(seed)
    known = set().union(*(shape for _, _, shape in _LINES))
    ordinary = [w for w in sample if not (len(w) > 2 and trigrams(w) & known)]
    pool = [w for words in ordinary for w in words] or [b"lorem", b"ipsum", b"dolor"]

    def filler(n: int) -> list[bytes]:
        return [pool[i] for i in rng.integers(0, len(pool), n)]

    def names(n: int) -> list[bytes]:
        """Made-up names, so that no word of the corpus speaks for an unknown licence."""
        return [bytes(rng.integers(97, 123, int(rng.integers(3, 10))).tolist()) for _ in range(n)]

    def variant(line: str) -> list[bytes]:
        words = words_of(line.format(b" ".join(names(int(rng.integers(1, 4)))).decode("ascii")))
        if len(words) > 4 and rng.random() < 0.5:
            words.pop(int(rng.integers(len(words))))
        if rng.random() < 0.4:
            words = filler(int(rng.integers(1, 8))) + words
        if rng.random() < 0.4:
            words = words + filler(int(rng.integers(1, 8)))
        return words

    def near_miss(line: str) -> list[bytes]:
        words: list[bytes] = []
        named = False
        for w in variant(line):
            if w not in NAMES:
                words.append(w)
            elif not named:
                words += names(int(rng.integers(1, 3)))
            named = w in NAMES
        return words

    examples, labels = [], []
    for c, lines in [(1, UNKNOWN_TEMPLATES), *((i, TEMPLATES[f]) for i, f in enumerate(CLASSES) if i > 1)]:
        for line in lines:
            for v in range(VARIANTS):
                examples.append(variant(line) if v else words_of(line.format("x")))
                labels.append(c)
            if c > 1 and NAMES & set(words := words_of(line)) and len(words) > 3:
                examples += [near_miss(line) for _ in range(VARIANTS // 4)]
                labels += [1] * (VARIANTS // 4)
    # Besides whole lines windows of them, as they are scored, mixed words, and one to three words (runs of them, or names).
    some = [w for w in ordinary if len(w) > WINDOW][:500]
    cut = [w[i : i + WINDOW] for w in some for i in [int(rng.integers(len(w) - WINDOW + 1))]]
    runs = [filler(int(rng.integers(1, 4))) for _ in range(600)] + [names(int(rng.integers(1, 4))) for _ in range(300)]
    for words in ordinary + cut + runs + [filler(int(rng.integers(3, 30))) for _ in range(300)]:
        examples.append(words)
        labels.append(0)
    y = np.array(labels)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    model = Model([examples[i] for i in used])
    rows = [model.features(model._codes(e)) for e in examples]
    squares = np.full_like(model.weights, 1e-6)
    share = np.bincount(y[used], minlength=len(CLASSES)) / len(used)
    weight = 1 / np.sqrt(np.maximum(share, 1e-9)) / np.sqrt(len(CLASSES))
    for _ in range(epochs):  # AdaGrad on batches
        shuffled = rng.permutation(used)
        for start in range(0, len(shuffled), 256):
            part = shuffled[start : start + 256]
            chosen = [rows[i] for i in part]
            p = model.probabilities(chosen)
            p[np.arange(len(part)), y[part]] -= 1
            p *= (weight[y[part]] / len(part))[:, None]
            sizes = np.array([len(r) for r in chosen])
            used_rows, at = np.unique(np.concatenate(chosen), return_inverse=True)
            gradient = 1e-5 * model.weights[used_rows]
            np.add.at(gradient, at, np.repeat(p / np.sqrt(sizes)[:, None], sizes, axis=0).astype(np.float32))
            squares[used_rows] += gradient * gradient
            model.weights[used_rows] -= RATE * gradient / np.sqrt(squares[used_rows])
    z = model.logits([rows[i] for i in aside])
    losses = []
    grid = np.exp(np.linspace(-2, 3, 51))
    for t in grid:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        losses.append(-(s[np.arange(len(aside)), y[aside]] - np.log(np.exp(s).sum(axis=1))).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train with the ordinary paragraphs of at most ``sample`` documents (``SAMPLE_LINES`` lines, 2,000 characters each).

    Those of lowest hash: ids beyond about four times the sample are passed over before their text is looked at, so what
    the tasks sort does not grow with the table.
    """
    share = min(1.0, 4 * sample / max(1, docs.count()))
    h = F.xxhash64("doc_id")
    low = F.lit(True) if share == 1.0 else (h < F.lit(int(-(2**63) + share * 2**64)))
    lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: F.trim(x) != "")
    step = F.greatest(F.floor(F.size(lines) / SAMPLE_LINES), F.lit(1)).cast("int")
    spread = F.filter(lines, lambda _, i: i % step == 0)
    picked = (
        docs.filter(low & F.col("text").isNotNull())
        .select(h.alias("h"), "doc_id", F.col("text").cast("string").alias("text"))
        .select("h", "doc_id", F.transform(F.slice(spread, 1, SAMPLE_LINES), lambda x: F.substring(x, 1, 2000)).alias("lines"))
        .orderBy("h", "doc_id", "lines")
        .limit(sample)
        .select("lines")
    )
    rows = materialise(picked).collect()  # one task merges what the others sorted, the driver gets the sample alone
    return train([w for r in rows for x in r["lines"] if (w := words_of(x))])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_paragraphs and its notices (line, family, probability, likeness)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_by_bytes(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                notices, counts = shared.value.scan(texts)
                found = [[dict(zip(("line", "family", "probability", "likeness"), x, strict=True)) for x in some] for some in notices]
                kind = pa.list_(
                    pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "notices"]
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(
        run, "doc_id long, n_paragraphs long, notices array<struct<line:int,family:string,probability:double,likeness:double>>"
    )
