from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.catalog import ENTITIES, load_catalog
from idcordon.operators.detect import scan_spans, with_hits
from idcordon.operators.redact import apply_action_mode
from idcordon.operators.report import detections_rollup, entity_counts, framework_rollup, text_report
from idcordon.operators.resolve import with_spans
from tests.plain import raw_spans, resolve

PIECES = [
    "234567890124", "2345 6789 0124", "ABCPE1234F", "27ABCPE1234F1ZB", "a/c: 123456789012",
    "Account Number #12345678901234", "HDFC0001234", "micr code 123456789", "123456789 cheque",
    "123456789 micr 987654321", "merchant@okaxis", "ab@ybl", "x.y-z@somebank", "joe@mail.example",
    "4532015112830366", "378282246310005", "CVV: 123", "security code 9876", "+91 98765 43210", "09876543210",
    "(0987) 654-3210", "PIN code 400 001", "zip:400001", "L17110MH1973PLC019786", "A1234567", "a12 34567",
    "ABC1234567", "MH-12-2018-0001234", "DL0420110012345", "२३४५ 6789 0124", "आ", "संख्या", "é", "ñ", "😀", "₹",
    "_", "½", "²", "‍", "́", "\x1c", "\n", "-", ".", "x", "7", "@", "ſecurity code 123", "K",
]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [
        rng.choice(["", " ", ", "]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 8)))
        for _ in range(n)
    ]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


def test_unchecked_hits_are_those_of_python(spark):
    values = texts(1500, 1)
    loose = ScanOptions(strict=False)
    got = with_hits(frame(spark, values), "text", loose).select("id", "hits").collect()
    for row in got:
        mine = sorted((h.start, h.end, h.ord, h.rank) for h in row.hits)
        assert mine == sorted(raw_spans(values[row.id])), repr(values[row.id])


def test_overlaps_and_redaction_against_plain_python(spark):
    values = texts(800, 2)
    found = with_spans(with_hits(frame(spark, values), "text", ScanOptions(strict=False)))
    spans = {r.id: r.spans for r in found.select("id", "spans").collect()}
    redacted = {
        r.id: r.redacted_text
        for r in text_report(frame(spark, values), "text", ScanOptions(strict=False)).collect()
    }
    for i, text in enumerate(values):
        kept = resolve(raw_spans(text))
        assert [(s.start, s.end, s.ord, s.rank) for s in spans[i]] == kept, repr(text)
        out = text
        for s in reversed(spans[i]):
            out = out[: s.start] + s.masked + out[s.end :]
        assert redacted[i] == out


def test_a_very_long_text(spark):
    one = "card 4532015112830366 and ABCPE1234F; call +91 9876543210 é😀 "
    report = text_report(frame(spark, [one * 1000, "clean"])).orderBy("id").collect()
    assert report[0].total_matches == 3000
    assert report[0].redacted_text == "card 4532-XXXX-XXXX-0366 and ABXXXXX34F; call +91-XXXXX-3210 é😀 " * 1000


def test_reports(spark):
    values = ["My PAN is ABCPE1234F, call +91 9876543210", "nothing here", "", None, "   ", "PIN code 400001"]
    rows = text_report(frame(spark, values)).orderBy("id").collect()
    assert [r.total_matches for r in rows] == [2, 0, 0, 0, 0, 1]
    assert [r.highest_severity for r in rows] == ["CRITICAL", None, None, None, None, "LOW"]
    assert [r.blocked_by_policy for r in rows] == [True, False, False, False, False, False]
    assert [r.pii_risk_score for r in rows] == [0.9, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert rows[0].violation_summary == (
        "RBI/SEBI Compliance Alert: Detected 2 sensitive PII item(s) (Permanent Account Number (PAN): 1, "
        "Indian Mobile / Telephone Number: 1). Highest Severity: CRITICAL."
    )
    assert rows[2].violation_summary == rows[3].violation_summary == "No text provided"
    assert rows[4].violation_summary.startswith("Clean")
    assert rows[0].redacted_text == "My PAN is ABXXXXX34F, call +91-XXXXX-3210"


def test_modes(spark):
    df = frame(spark, ["PAN ABCPE1234F", "PIN code 400001", "clean"])
    seen = {}
    for mode in ("BLOCK", "MASK", "WARN", "AUDIT"):
        options = ScanOptions(action_mode=mode)
        acted = apply_action_mode(text_report(df, "text", options), "text", options).orderBy("id").collect()
        seen[mode] = [(r.action_taken, r.text_out, r.warning is not None, r.blocked_by_policy) for r in acted]
    assert seen["BLOCK"] == [
        ("BLOCK", None, False, True), ("ALLOW", "PIN code 400001", False, False), ("ALLOW", "clean", False, False)]
    assert seen["MASK"] == [
        ("MASK", "PAN ABXXXXX34F", False, False), ("MASK", "PIN code 400XXX", False, False), ("ALLOW", "clean", False, False)]
    assert [s[0] for s in seen["WARN"]] == ["WARN", "WARN", "ALLOW"] and seen["WARN"][0][2]
    assert seen["AUDIT"][0] == ("AUDIT", "PAN ABCPE1234F", False, False)


def test_gates_lose_nothing(spark):
    from dataclasses import replace

    values = texts(600, 3)
    ungated = ScanOptions(catalog=tuple(replace(e, gate=None) for e in ENTITIES))
    with_gates = scan_spans(frame(spark, values), ["id"]).collect()
    without = scan_spans(frame(spark, values), ["id"], "text", ungated).collect()
    assert sorted(map(str, with_gates)) == sorted(map(str, without))


def test_partitioning_does_not_matter(spark):
    df = frame(spark, texts(300, 4))
    one = text_report(df.repartition(1)).drop("spans").collect()
    many = text_report(df.repartition(13)).drop("spans").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_redacted_cards_hold_no_card(spark):
    df = frame(spark, texts(300, 6))
    again = text_report(text_report(df).selectExpr("id", "redacted_text AS text"))
    kinds = entity_counts(again, ["id"]).select("entity_type").distinct().collect()
    assert "CREDIT_DEBIT_CARD" not in {k.entity_type for k in kinds}


def test_rollups_add_up(spark):
    found = with_spans(with_hits(frame(spark, texts(300, 7)).withColumn("g", F.col("id") % 3)))
    total = found.selectExpr("sum(size(spans)) AS n").first().n
    for by in (["key"], ["category"], ["severity"], ["category", "severity"]):
        assert detections_rollup(found, by, ["g"]).agg(F.sum("n_spans")).first()[0] == total
    per_kind = {r.entity_type: r.n_spans for r in detections_rollup(found, ["key"]).collect()}
    expected = sum(n * len(next(e for e in ENTITIES if e.key == k).frameworks) for k, n in per_kind.items())
    assert framework_rollup(found).agg(F.sum("n_spans")).first()[0] == expected


def test_catalog_file(spark, tmp_path):
    spec = {
        "entities": {
            "B_CODE": {"name": "Branch", "category": "BANKING_DATA", "severity": "LOW", "regex": r"\bB\d{2}\b"},
            "NO_PATTERN": {"name": "x"},
            "PAN": {"regex": r"\b[A-Z]{5}\d{4}[A-Z]\b", "checksum_algorithm": "pan_structure", "severity": "HIGH"},
        }
    }
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(spec, indent=1))
    loaded = load_catalog(spark, str(path))
    assert [e.key for e in loaded] == ["B_CODE", "PAN"]
    options = ScanOptions(catalog=loaded)
    got = scan_spans(frame(spark, ["B12 ABCPE1234F ABCDE1234F"]), ["id"], "text", options).collect()
    assert [(r.entity_type, r.start_index, r.masked_value) for r in got] == [
        ("B_CODE", 0, "[REDACTED_B_CODE]"), ("PAN", 4, "ABXXXXX34F")]


def test_a_context_pattern_must_end_with_its_group(spark, tmp_path):
    from idcordon.functions.catalog import ENTITIES, ends_with_its_group

    assert all(ends_with_its_group(e.pattern) for e in ENTITIES if e.context)
    assert not ends_with_its_group(r"(\d{9,18}) account") and not ends_with_its_group(r"(?:x (\d+))|y")
    assert ends_with_its_group(r"acc[(] (\d{9,18})\b(?!\d)")
    key = next(e.key for e in ENTITIES if e.context)
    path = tmp_path / "misplaced.json"
    path.write_text(json.dumps({"entities": {key: {"name": "x", "category": "BANKING_DATA", "severity": "HIGH",
                                                   "regulatory_frameworks": [], "regex": r"(\d{9,18}) account"}}}))
    with pytest.raises(ValueError, match="capture group"):
        load_catalog(spark, str(path))


def test_rows_are_dealt_only_on_request(spark):
    from idcordon.plans.views import PARTITIONS, dealt

    df = spark.range(50).coalesce(1)
    assert dealt(df).rdd.getNumPartitions() == 1
    spark.conf.set(PARTITIONS, "3")
    assert dealt(df).rdd.getNumPartitions() == 3
    spark.conf.unset(PARTITIONS)


def test_a_custom_pattern_keeps_its_alternatives(spark):
    from idcordon.functions.catalog import Entity

    mine = Entity("X", "x", "NATIONAL_ID", "HIGH", (), r"\b[A-Z]?\d{3}\b|zz")
    got = scan_spans(frame(spark, ["A123 456 zz B7"]), ["id"], "text", ScanOptions(catalog=(mine,)))
    assert [(r.start_index, r.end_index) for r in got.orderBy("start_index").collect()] == [(0, 4), (5, 8), (9, 11)]
