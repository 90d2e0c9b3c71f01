"""The network's temporary arrays are small beside an executor's memory, however much text comes at once."""

from __future__ import annotations

import tracemalloc

import numpy as np

from pitloom.llm.quality_cnn import Network


def test_scoring_needs_little_memory():
    net = Network(rng=np.random.default_rng(1))
    texts = [chr(97 + i % 26) * 4000 for i in range(500)]  # two million bytes, as many as the operator scores at once
    net.score(texts[:2])
    tracemalloc.start()
    scores = net.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 500
    assert peak < 60 << 20
