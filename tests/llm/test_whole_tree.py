"""Context trees without a bound on their strings, held against one tree in memory."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idcordon.llm import ctw
from idcordon.llm import words as w


def block_of(texts: list[str]) -> w.Block:
    data = [t.encode() for t in texts]
    return w.Block(0, np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


@pytest.mark.parametrize("nodes", [0, 40, 1 << 20])
@pytest.mark.parametrize("depth", [1, 3, 5])
def test_scores_are_those_of_the_whole_tree(spark, monkeypatch, nodes, depth):
    monkeypatch.setattr(ctw, "_PART_STRINGS", 64)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(["the ", "cat ", "sät ", "q", "жя ", "xy\n"], k=rng.randrange(60)))) for i in range(40)]
    rows += [(50, ""), (51, None), (52, rows[3][1]), (53, "\x00\x01 never seen \U0001f600"), (None, "zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    levels, (code, _) = [], ctw.strings(block_of([t or "" for i, t in rows if i is None or i % 4 != 1]), depth)
    for d in range(depth + 1):
        value, n = np.unique(code & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True)
        levels.append((value, n.astype(float)))
    want = ctw.Scorer(ctw.build_tree(levels)).texts_logp(block_of([t or "" for _, t in rows]))
    got = {r.doc_id: r.score for r in ctw.score(df, held, ctw.ScoreOptions(depth=depth, nodes=nodes)).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), rel=1e-5)
