from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from idcordon.functions.masks import mask
from idcordon.functions.validators import RULES, aadhaar_check_digit
from idcordon.operators.quality import check_named, validity_counts
from tests.plain import luhn_ok, verhoeff_ok

CASES = [
    ("aadhaar", "234567890124", True), ("aadhaar", "2345 6789 0124", True),
    ("aadhaar", "2345-6789-0124", True), ("aadhaar", "234567890125", False),
    ("aadhaar", "034567890124", False), ("aadhaar", "134567890124", False), ("aadhaar", "2345", False),
    ("aadhaar", "2३45 6789 0124", True),
    ("card", "4532015112830366", True), ("card", "5081234567890120", True),
    ("card", "4532 0151-1283 0366", True), ("card", "4532015112830367", False), ("card", "0000", False),
    ("gstin", "27AADCS1234F1ZP", True), ("gstin", " 27abcpe1234f1zb ", True),
    ("gstin", "27AADCS1234F1ZQ", False), ("gstin", "999999999999999", False), ("gstin", "00AADCS1234F1Z5", False),
    ("pan", "ABCPE1234F", True), ("pan", "xyzca5678g", True), ("pan", "ABCDE1234F", False),
    ("pan", "ABC1234F", False), ("pan", "ABCPE12345", False), ("pan", " ABCPE1234F\n", True),
    ("ifsc", "HDFC0001234", True), ("ifsc", "HDFC1001234", False), ("ifsc", "HDFC000123", False),
    ("upi", "merchant@okaxis", True), ("upi", "user_123@paytm", True), ("upi", "not_a_upi_vpa", False),
    ("upi", "a@b", False), ("upi", "x@y@z", False),
    ("phone", "+91 9876543210", True), ("phone", "09876543210", True), ("phone", "(098) 765-43210", True),
    ("phone", "1234567890", False), ("phone", "9999999999", False), ("phone", "98765", False),
    ("driving_licence", "MH-12-2018-0001234", True), ("driving_licence", "DL0420110012345", True),
    ("driving_licence", "XX9999999999999", False), ("driving_licence", "MH12", False),
    ("passport", "A1234567", True), ("passport", "a123 4567", True), ("passport", "Z9876543", False),
    ("passport", "12345678", False),
    ("cin", "L17110MH1973PLC019786", True), ("cin", "A17110MH1973PLC019786", False),
    ("cin", "L17110MH1873PLC019786", False),
    ("pin_code", "400001", True), ("pin_code", "400 001", True), ("pin_code", "012345", False),
    ("account", "123456789", True), ("account", "12345678", False), ("account", "1234567890123456789", False),
]


def test_literal_values(spark):
    for rule in RULES:
        mine = [(v, e) for r, v, e in CASES if r == rule] + [(None, None)]
        rows = spark.createDataFrame(mine, "value string, expected boolean")
        wrong = rows.where(F.expr(f"NOT (({RULES[rule]('value')}) <=> expected)")).collect()
        assert not wrong, (rule, wrong)


def test_checksums_against_plain_python(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choice("0123456789") for _ in range(11)) for _ in range(300)]
    made = spark.createDataFrame([(b,) for b in bodies], "body string").selectExpr(
        "body", f"{aadhaar_check_digit('body')} AS digit"
    ).collect()
    assert all(verhoeff_ok(r.body + r.digit) for r in made)
    cards = ["".join(rng.choice("0123456789") for _ in range(rng.choice([12, 13, 16, 19, 20]))) for _ in range(500)]
    got = spark.createDataFrame([(c,) for c in cards], "c string").selectExpr("c", f"{RULES['card']('c')} AS ok").collect()
    assert all(r.ok == (13 <= len(r.c) <= 19 and luhn_ok(r.c)) for r in got)


@pytest.mark.parametrize("bad", ["1234567890", "123456789012", "abc", ""])
def test_no_check_digit_for_other_lengths(spark, bad):
    assert spark.range(1).selectExpr(f"{aadhaar_check_digit(repr(bad))} AS d").first().d is None


def test_counts_and_names(spark):
    rows = spark.createDataFrame(
        [("a", "400001"), ("a", None), ("a", "0"), ("b", "0")], "grp string, value string"
    )
    got = {r.grp: tuple(r)[1:] for r in validity_counts(rows, "value", "pin_code", "grp").collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 1, 0, 0.0)}
    named = spark.createDataFrame(
        [("pan", "ABCPE1234F"), ("CIN", "x"), ("DL", None), ("what", "1"), (None, "1")], "entity string, value string"
    )
    verdicts = [r.verdict for r in check_named(named, "entity", "value").collect()]
    assert verdicts == ["valid", "invalid", "missing", "unknown", "unknown"]


def test_masks_and_fallback_tokens(spark):
    expected = {
        ("AADHAAR", "2345 6789 0124"): "XXXX-XXXX-0124", ("PAN", "ABCPE1234F"): "ABXXXXX34F",
        ("PAN", "AB"): "[REDACTED_PAN]", ("UPI_VPA", "merchant@okaxis"): "me***@okaxis",
        ("UPI_VPA", "ab@upi"): "***@upi", ("UPI_VPA", "none"): "[REDACTED_UPI]",
        ("CARD_CVV", "123"): "[REDACTED_CVV]", ("PHONE_IN", "+91 98765 43210"): "+91-XXXXX-3210",
        ("PIN_CODE_IN", "400 001"): "400XXX", ("PIN_CODE_IN", "4000"): "[REDACTED_PIN]",
        ("CREDIT_DEBIT_CARD", "4532015112830366"): "4532-XXXX-XXXX-0366",
        ("CIN_IN", "L17110MH1973PLC019786"): "L17110XXXXXXXXC019786", ("NEW_KIND", "1"): "[REDACTED_NEW_KIND]",
    }
    for (kind, value), masked in expected.items():
        got = spark.range(1).selectExpr(f"{mask(kind, repr(value))} AS m").first().m
        assert got == masked, (kind, value)
