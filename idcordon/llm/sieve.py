"""A bitmap of keys, sent to all tasks: rows that have none of the keys needn't be shuffled to a join with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): a bitmap of the keys' hashes; bits / 64 rows at most, however many keys there are."""
    bit = F.pmod(F.col(key), F.lit(bits))
    return keys.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(pmod({key}, 64) AS INT)))").alias("mask"))


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int) -> tuple[DataFrame, Column]:
    """The rows with the word of their bitmap, and whether ``column`` (a 64-bit hash) may be among the keys; never false for one that is."""
    sieve = F.broadcast(bitmap(keys, key, bits)).toDF("_word", "_mask")
    word = F.floor(F.pmod(F.col(column), F.lit(bits)) / 64).cast("int")
    hit = F.coalesce(F.expr(f"_mask & shiftleft(1L, CAST(pmod({column}, 64) AS INT)) <> 0"), F.lit(False))
    return rows.join(sieve, word == F.col("_word"), "left"), hit
