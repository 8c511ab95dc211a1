"""Identifier checks over columns of tables: how many values are valid, by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.functions.sql import name
from idcordon.functions.validators import RULES, aadhaar_check_digit, by_name


def validity_counts(df: DataFrame, value: str, rule: str, group: str) -> DataFrame:
    """Valid, invalid and null counts of one column and the rate of valid ones, by group.

    Only partial counts are shuffled, so a group may hold any share of the rows.
    """
    checked = df.selectExpr(
        f"{name(group)} AS grp", f"{name(value)} IS NULL AS missing",
        f"{RULES[rule](name(value))} AS valid",
    )
    counts = checked.groupBy("grp").agg(
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if("missing").alias("n_null"),
    )
    return counts.selectExpr(
        "grp", "n_valid", "n_invalid", "n_null",
        "try_divide(n_valid, n_valid + n_invalid) AS valid_rate",
    )


def check_named(df: DataFrame, entity: str, value: str, out: str = "verdict") -> DataFrame:
    """Check values whose entity stands in another column."""
    return df.select("*", F.expr(by_name(name(entity), name(value))).alias(out))


def append_check_digit(df: DataFrame, body: str, out: str = "check_digit") -> DataFrame:
    """Add the twelfth digit of eleven-digit bodies."""
    return df.select("*", F.expr(aadhaar_check_digit(name(body))).alias(out))
