"""Mixing sources to target weights by a low-discrepancy schedule.

The slots of the mix are the points of the binary van der Corput sequence. Cumulative target
weights cut the unit interval into one piece for each source, and a point belongs to the source
whose piece it falls into, so that every stretch of the mix holds its sources in their shares.
The r-th slot of a source takes block r of that source: its documents are shuffled by a hash of
their id, laid end to end, repeated, and cut into blocks of equal numbers of words.

How often a source occurred before a slot follows from the binary digits of the slot's number,
so ranks need no sort and no shuffle. Places inside a source come from sums over hash buckets,
so that a source with most rows is spread over many tasks.

Null texts and texts without words have size 0 and are never taken. Repeated rows are rows of
their own. A null source is a source like any other, last in order. An empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from idcordon.llm import words
from idcordon.sources.shared import stored

BITS = 40  # digits of a schedule point
_KEY = ["_key1", "_key2"]  # a row's id, source and text: two hashes


@dataclass(frozen=True)
class MixOptions:
    """share: words of the mix over all words. weights: by place of the source, repeating.

    repeats: most times a source's words are used. block_words: words of a slot at most, on
    average. max_sources: more sources are an error, since one row of each comes to the driver.
    """

    share: float = 1.5
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    repeats: float = 2.0
    block_words: int = 4096
    buckets: int = 1024
    max_sources: int = 100_000


def targets(sizes: list[int], options: MixOptions) -> list[float]:
    """Words wanted of each source: by weight, at most ``repeats`` times its size, excess reshared."""
    weights = [options.weights[i % len(options.weights)] for i in range(len(sizes))]
    caps = [options.repeats * s for s in sizes]
    left, out = options.share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.remove(i)
    return out


class Schedule:
    """Source and rank of any slot, by arithmetic on the slot's number alone."""

    def __init__(self, weights: list[float], slots: int) -> None:
        total = sum(weights)
        self.slots = slots
        edges = np.cumsum([0.0, *weights]) / total if total else np.zeros(len(weights) + 1)
        self.edges = np.minimum(np.round(edges * (1 << BITS)), 1 << BITS).astype(np.int64)
        self.edges[-1] = 1 << BITS

    @staticmethod
    def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros_like(x)
        for _ in range(bits):
            out = (out << 1) | (x & 1)
            x = x >> 1
        return out

    def _below(self, slot: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """How many points before the slot lie below the edge: a count for each one-digit of the edge."""
        out = np.where(edge >= 1 << BITS, slot, 0)
        for k in range(BITS):
            start = self._reversed(edge >> (BITS - k), k)
            step = 1 << (k + 1)
            count = np.maximum(0, (slot - start + step - 1) // step)
            out = out + np.where((edge >> (BITS - 1 - k)) & 1 == 1, np.where(edge < 1 << BITS, count, 0), 0)
        return out

    def source(self, slot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, self._reversed(slot, BITS), side="right") - 1

    def rank(self, slot: np.ndarray, source: np.ndarray) -> np.ndarray:
        return self._below(slot, self.edges[source + 1]) - self._below(slot, self.edges[source])

    def totals(self) -> np.ndarray:
        """Slots of each source."""
        return np.diff(self._below(np.full(len(self.edges), self.slots, dtype=np.int64), self.edges))


def sizes(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, size (words) and a content hash that orders rows with the same id."""
    carried = [c for c in columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], "text", F.xxhash64("text").alias("_content"))
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in columns], b["_content"], pa.array(words.counts(b["text"]), pa.int64())],
                names=[*columns, "_content", "_size"],
            )

    return rows.mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", _content long, _size long")


def _source_sizes(sized: DataFrame, options: MixOptions) -> list[tuple[str | None, int]]:
    """Words by source, in order. One row of each source; their number is checked."""
    got = sized.groupBy("source").agg(F.sum("_size").alias("size")).limit(options.max_sources + 1).collect()
    if len(got) > options.max_sources:
        raise ValueError(f"more than {options.max_sources} sources")
    return sorted(((r["source"], r["size"]) for r in got), key=lambda r: (r[0] is None, r[0] or ""))


@dataclass(frozen=True)
class Mix:
    """docs: every row with its place in its source; plan: the pieces of the mix; whole: the rows with all columns, if they are wanted."""

    docs: DataFrame
    plan: DataFrame
    whole: DataFrame | None = None


def mix(docs: DataFrame, options: MixOptions | None = None, extra: bool = False) -> Mix:
    """The mix of all documents.

    ``extra``: ``taken`` shall give all columns. ``docs``: doc_id and source, _size, _source_size, _target, _source_no
    and _start, the place of the document's first word in its source; (_source_no, _start) names a
    document with words. ``plan``: slot, source_no, start, doc_id, from_word and n_words: the slot holds so many words
    of the document from that word on.
    """
    options = options or MixOptions()
    spark = docs.sparkSession
    sized = stored(sizes(_keyed(docs), ["doc_id", "source", *_KEY]) if extra else sizes(docs, ["doc_id", "source"]), "mix-sizes")
    order = _source_sizes(sized, options)
    wanted = targets([s for _, s in order], options)
    slots = max(64 * len(order), int(np.ceil(sum(wanted) / options.block_words))) if sum(wanted) else 0
    schedule = Schedule([round(t) for t in wanted], slots)
    own = schedule.totals() if slots else np.zeros(len(order), dtype=np.int64)
    late = [i for i, t in enumerate(wanted) if round(t) and not own[i]]  # too small for a point: a slot at the end
    facts = spark.createDataFrame(
        [(i, name, size, float(t), round(t), max(int(own[i]), int(i in late)))
         for i, ((name, size), t) in enumerate(zip(order, wanted))],
        f"_source_no int, _name {dict(sized.dtypes)['source']}, _source_size long, _target double, _words long, _slots long",
    )
    # One row of each source, at most max_sources.
    placed = _placed(sized, facts, options)
    return Mix(placed, _plan(spark, placed, schedule, late), docs if extra else None)


def _keyed(docs: DataFrame) -> DataFrame:
    parts = [part for c in ("doc_id", "source", "text") for part in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn("_key1", F.xxhash64(*parts)).withColumn("_key2", F.xxhash64(F.lit(7), *parts))


def _placed(sized: DataFrame, facts: DataFrame, options: MixOptions) -> DataFrame:
    """Adds the facts of its source and its start in the shuffled source to each document."""
    known = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    keyed = known.withColumn("_shuffle", F.xxhash64("doc_id", F.lit(20))).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(options.buckets)).cast("int")
    )
    sums = keyed.groupBy("_source_no", "_bucket").agg(F.sum("_size").alias("_bucket_size"))
    before = Window.partitionBy("_source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source_no", "_bucket", F.coalesce(F.sum("_bucket_size").over(before), F.lit(0)).alias("_bucket_start"))
    inside = (
        Window.partitionBy("_source_no", "_bucket")
        .orderBy("_shuffle", "doc_id", "_size", "_content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(sums, ["_source_no", "_bucket"])
        .withColumn("_start", F.col("_bucket_start") + F.col("_inner"))
        .drop("_shuffle", "_bucket", "_inner", "_bucket_start", "_content")
    )


def _plan(spark: SparkSession, placed: DataFrame, schedule: Schedule, late: list[int]) -> DataFrame:
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b["id"].to_numpy()
            source = schedule.source(slot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(source.astype(np.int32)), pa.array(schedule.rank(slot, source))],
                names=["slot", "source_no", "rank"],
            )

    slots = spark.range(schedule.slots).mapInArrow(points, "slot long, source_no int, rank long")
    if late:
        extra = [(schedule.slots + k, i, 0) for k, i in enumerate(late)]
        slots = slots.unionByName(spark.createDataFrame(extra, slots.schema))
    # Pass 0 and the repeats of a source: words [begin, end) of the repeated source, as far as it is wanted.
    named = placed.selectExpr(
        "doc_id", "_source_no AS source_no", "_start AS start", "_size AS size", "_source_size AS source_size", "_words AS words", "_slots AS slots"
    )
    used = (
        named.where("size > 0 AND slots > 0")
        .withColumn("pass", F.explode(F.expr("sequence(0L, greatest(0L, (words - 1) div source_size))")))
        .withColumn("begin", F.expr("start + pass * source_size"))
        .withColumn("end", F.expr("least(begin + size, words)"))
        .where("begin < words")
    )
    # Block r holds words [r * words div slots, (r + 1) * words div slots); the first guess is at most one off.
    first, last = (f"CAST(floor(CAST({x} AS DECIMAL(20, 0)) * slots / words) AS BIGINT)" for x in ("begin", "(end - 1)"))
    pieces = (
        used.withColumn("rank", F.explode(F.expr(f"sequence(greatest(0L, {first} - 1L), least(slots - 1L, {last} + 1L))")))
        .withColumn("lo", F.expr("greatest(begin, CAST(CAST(rank AS DECIMAL(20, 0)) * words div slots AS BIGINT))"))
        .withColumn("hi", F.expr("least(end, CAST(CAST(rank + 1 AS DECIMAL(20, 0)) * words div slots AS BIGINT))"))
        .where("hi > lo")
        .selectExpr("source_no", "rank", "start", "doc_id", "lo - begin AS from_word", "hi - lo AS n_words")
    )
    return slots.join(pieces, ["source_no", "rank"]).select("slot", "source_no", "start", "doc_id", "from_word", "n_words")


def taken(mixed: Mix) -> DataFrame:
    """Every row of the documents with size, source_size, target and taken: the words the mix takes of it, repeats counted.

    Columns of the documents that have these names are replaced.
    """
    sums = mixed.plan.groupBy("source_no", "start").agg(F.sum("n_words").alias("_taken")).toDF("_no", "_at", "_taken")
    words = mixed.docs.where("_size > 0").join(sums, (F.col("_source_no") == F.col("_no")) & (F.col("_start") == F.col("_at")), "left")
    all_rows = words.unionByName(mixed.docs.where("_size = 0"), allowMissingColumns=True)
    made = {"size": "_size", "source_size": "_source_size", "target": "_target", "taken": "coalesce(_taken, 0L)"}
    key = [] if mixed.whole is None else _KEY
    rows = all_rows.selectExpr("doc_id", "source", *key, *[f"{e} AS {c}" for c, e in made.items()])
    return rows if mixed.whole is None else _with_whole(mixed.whole, rows, list(made))


def _with_whole(docs: DataFrame, rows: DataFrame, made: list[str]) -> DataFrame:
    """The whole rows with the columns made. They are shuffled once, by key.

    Rows of one key differ in other columns only: they have one size and follow one another in their source, so that
    few values of taken occur among them. A row gets one of these by its number.
    """
    facts = [c for c in made if c != "taken"]
    counts = rows.repartition(*_KEY).groupBy(*_KEY, *facts, "taken").agg(F.count("*").alias("n"))
    shares = counts.groupBy(*_KEY).agg(
        F.first(F.struct(*facts)).alias("_facts"), F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("_shares")
    )
    kept = [c for c in docs.columns if c not in made]
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text" and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    before = F.row_number().over(Window.partitionBy(*_KEY).orderBy(*others)) - 1
    whole = _keyed(docs).withColumn("_before", before.cast("long")).join(shares, _KEY)
    own = F.expr(
        "aggregate(_shares, named_struct('left', _before, 'own', CAST(NULL AS BIGINT)), (a, s) -> named_struct('left', a.left - s.n, "
        "'own', coalesce(a.own, if(a.left < s.n, s.taken, NULL))), a -> a.own)"
    )
    return whole.select(*[F.col(f"`{c}`") for c in kept], *[(own if c == "taken" else F.col(f"_facts.{c}")).alias(c) for c in made])
