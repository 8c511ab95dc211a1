"""Counting the shingles of a stretch: right, and without copies of all of them."""

from __future__ import annotations

import tracemalloc

import numpy as np

from idcordon.llm import setjoin


def test_several_counts_in_place():
    for n in (0, 1, 3, 4, 1000):
        held = np.random.default_rng(n).integers(0, 120, n).astype(np.uint64)
        value, count = np.unique(held, return_counts=True)
        got = setjoin.several(held, 4)
        assert got[0].tolist() == value[count >= 4].tolist() and got[1].tolist() == count[count >= 4].tolist()
    held = np.random.default_rng(7).integers(0, 1 << 40, 1 << 20).astype(np.uint64)
    tracemalloc.start()
    setjoin.several(held, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < held.nbytes / 2  # np.unique of all takes over three times as much as they do
