"""The whole pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from idcordon.llm import decontam
from idcordon.sources.shared import stored
from pyspark.sql import functions as F
from tests.llm.test_operators import jaccard_by_force, shingles, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut_by_force(texts, length=corpus_pipeline.REPEAT_BYTES):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out.append(bytes(x for x, c in zip(b, covered) if not c).decode(errors="ignore"))
    return out


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [{r.doc_id: r for r in docs.collect()}]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        rows = docs.collect()
        seen.append({r.doc_id: r for r in rows})
        assert len(seen[-1]) == len(rows) and set(seen[-1]) <= set(seen[-2])
        assert docs.columns[:5] == COLUMNS
    raw, good, single, cut, clean, mixed = seen
    wrong = [i for i, q in labels.items() if (i in good) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    groups = defaultdict(list)
    for i, n, component in jaccard_by_force([(i, r.text) for i, r in good.items()]):
        groups[component if n else (i,)].append(i)
    assert set(single) == {min(v) for v in groups.values()}
    want = dict(zip(single, cut_by_force([(r.text or "").encode() for r in single.values()])))
    assert {i: r.text for i, r in cut.items()} == {i: t for i, t in want.items() if t or not single[i].text}
    assert all(r.n_chars == len(r.text) for i, r in cut.items() if r.text != single[i].text)
    items = [set(shingles(r.text, 3)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(cut) - set(clean)
    whole = {i for i, r in cut.items() if any(x and x <= set(shingles(r.text, 3)) for x in items)}
    assert whole <= gone
    leaks = decontam.leaks(spark.createDataFrame([(i, cut[i].text) for i in cut], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert gone == {r.doc_id for r in leaks.collect()}
    assert all(r["size"] == len(words(r.text)) and 0 < r.taken <= 2 * r["size"] for r in mixed.values())


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == [*COLUMNS, "size", "taken"] and rows.agg(F.sum("taken")).first()[0] > 0
