"""Sources and sinks that are files, bytes that are no UTF-8, and the cube of detections."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.catalog import ENTITIES
from idcordon.operators.detect import with_hits
from idcordon.operators.report import detections_cube
from idcordon.operators.resolve import with_spans
from idcordon.sources.records import parse_events, read_lines, read_transcripts
from idcordon.sources.shared import shared_dir, stored
from idcordon.sources.sinks import read_routed, write_routed


def test_broken_bytes_become_replacement_characters(spark):
    """One U+FFFD for each longest broken sequence, as Python has it."""
    rng = random.Random(4)
    parts = [b"\xff", b"\xe2\x82", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80", b"\x80", b"\xf5", b"\xe2\x28\xa1", "é₹😀".encode(), b"abc", b" "]
    texts = [b"".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = [(i, bytearray(b'{"conversationId":"' + t + b'"}')) for i, t in enumerate(texts)] + [(900, None), (901, bytearray(b"")), (902, bytearray(b"\xff\xfe"))]
    got = {r.i: (r.conversation_id, r.event is None) for r in parse_events(spark.createDataFrame(rows, "i int, payload binary")).collect()}
    assert all(got[i] == (t.decode("utf-8", "replace"), False) for i, t in enumerate(texts))
    assert [got[i] for i in (900, 901, 902)] == [("unknown", True)] * 3


def written(spark, files: dict[str, bytes]) -> str:
    """The files below a folder, through Spark's file system."""
    path = shared_dir(spark, "lines")
    context = spark.sparkContext
    for name, data in files.items():
        place = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
        out.write(data, 0, len(data))
        out.close()
    return path


@pytest.mark.parametrize("split", ["200b", "128m"])
def test_lines_are_numbered_across_splits(spark, split):
    rng = random.Random(1)
    lines = {f"{n}.jsonl": ["" if rng.random() < 0.2 else f"{n} {i} " + "x" * rng.randrange(60) for i in range(k)] for n, k in (("a", 300), ("b", 1), ("c", 0), ("d", 70))}
    path = written(spark, {n: "\n".join(x).encode() + (b"\n" if n == "d.jsonl" else b"") for n, x in lines.items()})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = read_lines(spark, path).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((n, i, x) for n, ls in lines.items() for i, x in enumerate(ls))
    assert sorted((r.file.rpartition("/")[2], r.line_no, r.line) for r in got) == want


def test_transcripts_leave_broken_bytes_out(spark):
    path = written(spark, {"t.jsonl": b'{"type":"USER_INPUT","content":"a\xff\xe2\x82b"}\nbroken\n\n{"source":"USER_EXPLICIT","content":"c"}'})
    got = [(r.line_no, r.type, r.source, r.content) for r in read_transcripts(spark, path).orderBy("line_no").collect()]
    assert got == [(0, "USER_INPUT", "", "ab"), (3, "", "USER_EXPLICIT", "c")]


def test_routed_records_lie_in_folders(spark):
    rows = [(i, ["RBI_MD_IT_2023"] if i % 3 == 0 else ["X"] if i % 3 == 1 else None, {"a": "b"}) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, regulatory_frameworks array<string>, m map<string,string>")
    path = shared_dir(spark, "routed")
    write_routed(df, path)
    regulated = read_routed(spark, path)
    assert {r.i for r in regulated.collect()} == {i for i in range(60) if i % 3 == 0}
    assert read_routed(spark, path, "general").count() == 40
    assert "PartitionFilters: [isnotnull(store" in regulated._jdf.queryExecution().executedPlan().toString()


def test_cube_counts_texts_once(spark):
    texts = ["PAN ABCPE1234F and ABCPE1234F, IFSC HDFC0001234", "card 4532015112830366 call +91 9876543210", "nothing", None, "PAN XYZCA5678G"]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts * 2, ["a", "a", "b", "b", None] * 2))], "i int, text string, grp string")
    spans = stored(with_spans(with_hits(df)), "spans")
    rows = [(e.key, e.category, e.severity, r.grp, r.i) for r in spans.collect() for q in r.spans for e in [ENTITIES[q.ord]]]
    want = {}
    for size in range(5):
        for over in combinations(range(4), size):
            for row in rows:
                key = tuple(None if i in over else row[i] for i in range(4)) + (sum(8 >> i for i in over),)
                want.setdefault(key, []).append(row[4])
    cube = detections_cube(spans, ["grp"])
    got = {tuple(r[:5]): (r.n_spans, r.n_texts) for r in cube.select("entity_type", "category", "severity", "grp", "grouping_id", "n_spans", "n_texts").collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert cube._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert detections_cube(spans).where("grouping_id = 7").first().n_spans == len(rows)
    assert detections_cube(spans, options=ScanOptions()).columns == ["entity_type", "category", "severity", "grouping_id", "n_spans", "n_texts"]


def test_empty_folder_of_the_cube(spark):
    none = spark.createDataFrame([], "i int, text string, grp string").withColumn("x", F.lit(1))
    assert detections_cube(with_spans(with_hits(none)), ["grp"]).collect() == []
