"""Sketches spare pairs that can't link, and only those."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from idcordon.llm import setjoin


def _drawn(sets: list[np.ndarray]) -> list[list[int]]:
    n = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    return setjoin.sketches(n, starts, np.concatenate([np.sort(s) for s in sets])).to_pylist()


def test_differing_bits_never_exceed_the_shingles_of_one_set_only(spark):
    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 2, 31, 33, 64, 65, 300, 1025):
        for other in (size, max(1, size * 3 // 4), size * 4 // 3):
            for common in (0, min(size, other) // 2, min(size, other)):
                pool = rng.integers(0, 1 << 63, size + other, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                a, b = pool[:size], pool[size - common : size - common + other]
                x, y = _drawn([a, b])
                rows.append((x, y, size + other - 2 * common))
    found = spark.createDataFrame(rows, "x array<long>, y array<long>, only long").withColumn("d", F.expr(setjoin.differing("x", "y")))
    assert found.where("d > only OR d IS NULL").count() == 0
    assert found.where("only = 0 AND d > 0").count() == 0
    short = found.selectExpr("only", f"{setjoin.shortened('x', 8)} AS x", f"{setjoin.shortened('y', 8)} AS y")
    assert short.where("size(x) > 8 OR size(y) > 8").count() == 0
    assert short.withColumn("d", F.expr(setjoin.differing("x", "y"))).where("d > only OR only = 0 AND d > 0").count() == 0
    assert found.where("only > 200 AND d < 100").count() == 0  # and they tell different sets apart
    assert spark.range(1).select(F.expr(setjoin.differing("array(1L, 2L, 3L, 4L, 5L, 6L, 7L, 8L)", "array(1L, 2L)"))).first()[0] is None


def test_pairs_that_cannot_link_are_not_compared(spark, monkeypatch):
    """Twenty pairs of texts with 120 of 240 words in common share lists but don't link; five copies of one text with a word added do."""
    rng = np.random.default_rng(6)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    pairs = [words(120) for _ in range(20)]
    texts = [" ".join(pairs[k // 2] + words(120)) for k in range(40)]
    texts += [texts[0] + f" e{i}" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, linked = [], setjoin._linked

    def counted(pairs, sets, options):
        compared.append(pairs.count())
        return linked(pairs, sets, options)

    monkeypatch.setattr(setjoin, "_linked", counted)
    options = setjoin.JaccardOptions(crowd=3)
    got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(docs, options).collect()}
    assert got == {i: 0 if i >= 40 else i for i in range(45)}
    assert sum(compared) <= 15  # the links among six texts
