"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A text's set is its distinct word shingles. Two sets link when ``100 * common >= percent *
union``. Texts with the same set form one class, and only classes are joined.

Linked sets of n and m shingles share at least alpha(n, m) = ceil(percent * (n + m) / (100 +
percent)) of them, so under one order of all shingles (rare first) they share one among their
first n - alpha + 1, and two among their first n - alpha + 2. Small sets are light: they
enumerate the two-shingle subsets of that prefix, each a key that few other sets have. Large
sets are heavy: they are found by scanning the inverted lists of single prefix shingles, into
which those light sets go too that a heavy set can link with. The boundary is the size at
which the number of subsets outgrows the lists' measured length.

Lists of large groups of near copies are not expanded into pairs. In each list every set is
first compared with the best covered one (the set with the largest share of shingles that
others have too), the list's head; what links becomes one component. Only sets of different
components that still share a list, or lists with one head, are then compared with each other,
so no link between components is lost.

Before two sets are brought together, their sketches are: the parities of a set's shingles by hash
value, two to four bits a shingle. Each bit in which two sketches differ needs a shingle that only one of the sets
has, so a pair whose sketches differ in too many bits can't link, and no other pair is put aside.

Defined results: no words or null text: an empty set, linked with nothing. Fewer words than a
shingle has: the whole sequence is the one shingle. Repeated rows and ids are rows like any
other; component_id is the smallest id reachable, null if all are null. Other columns of the
input are not read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from idcordon.llm import words as W
from idcordon.llm.components import components
from idcordon.llm.sieve import bitmap as _sieve
from idcordon.sources.shared import settled, stored

_U = np.uint64
_SUBSET = _U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class JaccardOptions:
    """words: of a shingle. percent: least similarity.

    frequent: so many of the most frequent shingles come last in the order; any number gives the
    same links. part: lists of known longer shingles are dealt to several tasks of about so many.
    crowd: from this list length on, sketches are compared before a pair is written. light_limit: the boundary
    is looked for up to this size. sieve_bits: of the bitmap that spares texts a shuffle.
    """

    words: int = 5
    percent: int = 75
    frequent: int = 1 << 17
    part: int = 1024
    crowd: int = 32
    light_limit: int = 64
    count_shingles: int = 1 << 22
    sieve_bits: int = 1 << 24


def alpha(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common shingles of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def smallest_partner(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


# ---------------------------------------------------------------- sets of a block


def text_sets(block: W.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle) of a block's distinct shingles, ordered by both."""
    words = W.split(block)
    hashes = W.word_hashes(block, words)
    grams = W.gram_hashes(hashes, k)
    whole = words.text[: len(grams)] == words.text[k - 1 :][: len(grams)] if len(grams) else np.zeros(0, dtype=bool)
    text, value = words.text[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < k))
    if len(short):
        own = [W.mix64(np.bitwise_xor.reduce(W.mix64(hashes[a:b] + np.arange(a, b).astype(_U) - _U(a))).reshape(1) + _U(b - a))[0]
               for a, b in zip(words.first[short], words.first[short + 1])]
        text, value = np.concatenate([text, short]), np.concatenate([value, np.array(own, dtype=_U)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[first], value[first]


def set_ids(n: np.ndarray, starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of each nonempty set."""
    total = np.add.reduceat(W.mix64(value), starts) if len(starts) else np.zeros(0, dtype=_U)
    return W.mix64(total + n.astype(_U)).view(np.int64)


def sketches(n: np.ndarray, starts: np.ndarray, value: np.ndarray) -> pa.ListArray:
    """Parities of each nonempty set's shingles, in 64-bit words; the number of words is a power of two.

    A shingle's word is told by its highest bits, so neighbouring words fold into one of a sketch of half the length.
    """
    high = np.maximum(1, np.ceil(np.log2(np.maximum(n, 1) / 32))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(1 << high)])
    words = np.zeros(ends[-1], dtype=_U)
    if len(value):
        place = np.repeat(ends[:-1], n) + (value >> np.repeat(_U(64) - high.astype(_U), n)).astype(np.int64)  # ascending, as the shingles are
        first = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[first]] = np.bitwise_xor.reduceat(_U(1) << (value & _U(63)), first)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.view(np.int64)))


def _bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a set, where each begins in the flat arrays, and its size."""
    starts = np.flatnonzero(np.diff(text, prepend=-1)) if len(text) else np.zeros(0, dtype=np.int64)
    return text[starts], starts, np.diff(starts, append=len(text))


def signatures(docs: DataFrame, options: JaccardOptions) -> DataFrame:
    """doc_id, content (hash of the text), set_id (null for an empty set), n_shingles and sketch (empty for an empty set) of every row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in W.blocks(b["text"]):
                n, ids = np.zeros(block.n, dtype=np.int64), np.zeros(block.n, dtype=np.int64)
                text, value = text_sets(block, options.words)
                own, starts, sizes = _bounds(text)
                n[own] = sizes
                ids[own] = set_ids(sizes, starts, value)
                rank = np.cumsum(n > 0) - 1
                drawn = sketches(sizes, starts, value).take(pa.array(rank, mask=n == 0))
                doc_id, content = (b[c].slice(block.first, block.n) for c in ("doc_id", "content"))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, content, pa.array(ids, mask=n == 0), pa.array(n), drawn],
                    names=["doc_id", "content", "set_id", "n_shingles", "sketch"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, content long, set_id long, n_shingles long, sketch array<long>")


# ---------------------------------------------------------------- order and boundary


def several(held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur ``least`` times or more, and how often. Sorts in place: no copy of all values is made."""
    held.sort()
    again = held[: max(0, len(held) - least + 1)]
    value, count = np.unique(again[again == held[least - 1 :]], return_counts=True)
    return value, count + least - 1


def _counted(docs: DataFrame, options: JaccardOptions) -> DataFrame:
    """(small, shingle, count): shingles frequent in a stretch of the rows; and lists of the small sets' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = np.empty(options.count_shingles, dtype=_U), 0

        def frequent() -> pa.RecordBatch:
            value, count = several(held[:filled], 4)
            often = np.argsort(count)[::-1][: options.frequent]
            return batch(False, value[often], count[often])

        def batch(small: bool, value: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(value), small)), pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))],
                names=["small", "shingle", "count"],
            )

        for b in batches:
            for block in W.blocks(b["text"]):
                text, value = text_sets(block, options.words)
                rest = value
                while len(rest):
                    part, rest = rest[: len(held) - filled], rest[len(held) - filled :]
                    held[filled : filled + len(part)] = part
                    filled += len(part)
                    if filled == len(held):
                        yield frequent()
                        filled = 0
                _, starts, n = _bounds(text)
                place = np.arange(len(text)) - np.repeat(starts, n)
                size = np.repeat(n, n)
                probe = size - alpha(size, smallest_partner(size, options.percent), options.percent) + 1
                few = (size <= options.light_limit) & (place < probe)
                if few.any():
                    yield batch(True, *np.unique(value[few], return_counts=True))
        if filled:
            yield frequent()

    return (
        docs.select("text").mapInArrow(run, "small boolean, shingle long, count long")
        .groupBy("small", "shingle").agg(F.sum("count").alias("count"))
    )


def boundary(sizes: dict[int, int], length: float, options: JaccardOptions) -> int:
    """The largest light size by cost: keys of all light sets and, for the others, list entries and what they meet.

    ``sizes``: number of classes by set size up to ``light_limit``; ``length``: mean length of a list.
    """
    best, cost_of_best = 0, None
    n = np.arange(1, options.light_limit + 1)
    prefix = n - alpha(n, smallest_partner(n, options.percent), options.percent)
    able = alpha(n, smallest_partner(n, options.percent), options.percent) >= 2
    light, heavy = (prefix + 2) * (prefix + 1) / 2, (prefix + 1) * (1 + length)
    number = np.array([sizes.get(int(k), 0) for k in n])
    for x in range(options.light_limit + 1):
        cost = float((number[:x] * light[:x])[able[:x]].sum() + (number[x:] * heavy[x:]).sum())
        if cost_of_best is None or cost < cost_of_best:
            best, cost_of_best = x, cost
    return best


# ---------------------------------------------------------------- lists


@dataclass(frozen=True)
class _Order:
    """Frequent shingles with their counts, and the light boundary."""

    shingles: np.ndarray
    counts: np.ndarray
    light: int


def _postings(docs: DataFrame, order: _Order, options: JaccardOptions) -> DataFrame:
    """(key, part, set_id, n, tag): every class in the lists of its prefix; tag: also as the smaller of a pair."""
    shared = docs.sparkSession.sparkContext.broadcast((order.shingles, order.counts))  # at most options.frequent entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = shared.value
        table, seen = W.Table(shingles), set()
        counts = np.append(counts, 0)
        for b in batches:
            for block in W.blocks(b["text"]):
                text, value = text_sets(block, options.words)
                _, starts, n = _bounds(text)
                ids = set_ids(n, starts, value)
                fresh = np.array([i not in seen and not seen.add(i) for i in ids.tolist()], dtype=bool)
                keep = np.repeat(fresh, n)
                text, value = text[keep], value[keep]
                _, starts, n = _bounds(text)
                count = counts[table.find(value)]
                by = np.lexsort((value, count, text))
                yield from _entries(ids[fresh], starts, n, value[by], count[by])

    def _entries(ids: np.ndarray, starts: np.ndarray, n: np.ndarray, value: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.arange(len(value)) - np.repeat(starts, n)
        size, who = np.repeat(n, n), np.repeat(ids, n)
        index = size - alpha(size, size, options.percent)
        probe = size - alpha(size, smallest_partner(size, options.percent), options.percent)
        light = size <= order.light
        single = np.where(light, (place < index + 1) & (size >= smallest_partner(np.int64(order.light + 1), options.percent)), place < probe + 1)
        yield _rows(value[single], count[single], who[single], size[single], (place < index + 1)[single])
        for k in np.flatnonzero(n <= order.light):
            p, i = int(probe[starts[k]]) + 2, int(index[starts[k]]) + 2
            if n[k] < 2:
                continue
            own, often = value[starts[k] : starts[k] + p], count[starts[k] : starts[k] + p]
            a, c = np.triu_indices(len(own), 1)
            key = W.mix64(np.minimum(own[a], own[c]) * _SUBSET + np.maximum(own[a], own[c]))
            size_k = np.full(len(key), n[k])
            yield _rows(key, np.minimum(often[a], often[c]), np.full(len(key), ids[k]), size_k, c < i)

    def _rows(key: np.ndarray, count: np.ndarray, who: np.ndarray, size: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        parts = count // options.part + 1
        part = np.where(parts > 1, (W.mix64(who.view(_U)) % parts.astype(_U)).astype(np.int64), -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(who), pa.array(size.astype(np.int32)), pa.array(tag)],
            names=["key", "part", "set_id", "n", "tag"],
        )

    return docs.select("text").mapInArrow(run, "key long, part int, set_id long, n int, tag boolean")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """The lists with at least two classes, each class once; length: classes of the list's part."""
    names = ["key", "part", "set_id", "n", "tag"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # of the last list, which the next batch may go on with
        for b in batches:
            new = [np.asarray(b[c].to_numpy(zero_copy_only=False)) for c in names]
            now = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            if len(now[0]):
                last = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
                cut = int(last[-1]) + 1 if len(last) else 0
                rest = [x[cut:] for x in now]
                yield from lists([x[:cut] for x in now])
        if rest:
            yield from lists(rest)

    def lists(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, who = cols[:3]
        if not len(key):
            return
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        once = new.copy()
        once[1:] |= who[1:] != who[:-1]
        run = np.cumsum(new)[once] - 1
        length = np.bincount(run)[run]
        keep = (length > 1) | (part[once] >= 0)
        out = [x[once][keep] for x in cols]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, length[keep].astype(np.int32))], names=[*names, "length"])

    dealt = postings.repartition("key", "part").sortWithinPartitions("key", "part", "set_id")
    return dealt.mapInArrow(scan, "key long, part int, set_id long, n int, tag boolean, length int")


# ---------------------------------------------------------------- comparing


def _sets_of(docs: DataFrame, signed: DataFrame, wanted: DataFrame, options: JaccardOptions) -> DataFrame:
    """(set_id, shingles): the shingles of the wanted classes.

    Texts are joined by content; a bitmap of fixed size, sent to all tasks, first drops most of the others.
    """
    place = F.struct("content", "doc_id")
    one = (
        signed.join(wanted, "set_id", "left_semi")
        .groupBy("set_id").agg(F.min(place).alias("at"))
        .select(F.col("at.content").alias("of_content"), F.col("at.doc_id").alias("the_id")).distinct()
    )
    one = stored(one, "wanted")
    sieve = F.broadcast(_sieve(one, "of_content", options.sieve_bits))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("content")).where(F.col("text").isNotNull())
    bit = F.pmod(F.col("content"), F.lit(options.sieve_bits))
    texts = texts.join(sieve, F.floor(bit / 64).cast("int") == F.col("word")).where(
        F.expr("mask & shiftleft(1L, CAST(pmod(content, 64) AS INT)) <> 0")
    )
    # An inner join with distinct rows: a semi-join would be pushed below the bitmap.
    found = texts.join(one, (F.col("content") == F.col("of_content")) & F.col("doc_id").eqNullSafe(F.col("the_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows come to one task
        for b in batches:
            for block in W.blocks(b["text"]):
                text, value = text_sets(block, options.words)
                _, starts, n = _bounds(text)
                ids = set_ids(n, starts, value)
                fresh = np.array([i not in seen and not seen.add(i) for i in ids.tolist()], dtype=bool)
                ends = np.concatenate([[0], np.cumsum(n[fresh])]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[np.repeat(fresh, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), own], names=["set_id", "shingles"])

    return found.select("text").mapInArrow(run, "set_id long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, options: JaccardOptions) -> DataFrame:
    """Those of the pairs (a, b) that link. Compared in the JVM, row by row: batches of pairs of long sets would be large."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a")
    return met.where(100 * both >= options.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _sketches_of(signed: DataFrame, wanted: DataFrame, options: JaccardOptions) -> DataFrame:
    """(set_id, size, sketch) of the wanted classes (set_id, distinct); a bitmap of them first drops most others, unshuffled."""
    wanted = stored(wanted, "wanted")
    sieve = F.broadcast(_sieve(wanted, "set_id", options.sieve_bits))
    bit = F.pmod(F.col("set_id"), F.lit(options.sieve_bits))
    likely = signed.select("set_id", "n_shingles", "sketch").join(sieve, F.floor(bit / 64).cast("int") == F.col("word")).where(
        F.expr("mask & shiftleft(1L, CAST(pmod(set_id, 64) AS INT)) <> 0")
    )
    # An inner join with distinct rows: a semi-join would be pushed below the bitmap.
    return likely.join(wanted, "set_id").groupBy("set_id").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))


def differing(one: str, other: str) -> str:
    """In how many bits two sketches differ; the longer one is folded once. Null if it is longer still, or one is null."""

    def folded(x: str, to: str) -> str:
        return f"if(size({x}) > size({to}), transform(sequence(0, size({to}) - 1), i -> get({x}, 2 * i) ^ get({x}, 2 * i + 1)), {x})"

    bits = f"zip_with({folded(one, other)}, {folded(other, one)}, (x, y) -> bit_count(x ^ y))"
    near = f"size({one}) <= 2 * size({other}) AND size({other}) <= 2 * size({one})"
    return f"CASE WHEN {one} IS NOT NULL AND {other} IS NOT NULL AND {near} THEN aggregate({bits}, 0, (t, d) -> t + d) END"


def shortened(sketch: str, words: int) -> str:
    """The sketch folded to so many words (a power of two) at most."""
    part = f"size({sketch}) div {words}"
    fold = f"transform(sequence(0, {words - 1}), i -> aggregate(slice({sketch}, i * int({part}) + 1, int({part})), 0L, (t, x) -> t ^ x))"
    return f"if(size({sketch}) > {words}, {fold}, {sketch})"


def _near(n: str, m: str, one: str, other: str, options: JaccardOptions) -> str:
    """Whether sets of sizes n and m with these sketches can link: what only one of them has are at least the differing bits."""
    p = options.percent
    return f"coalesce((100 + {p}) * ({n} + {m} - {differing(one, other)}) >= 2 * {p} * ({n} + {m}), true)"


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def _sifted(pairs: DataFrame, signed: DataFrame, options: JaccardOptions) -> DataFrame:
    """The pairs (a, b) that can link by their sketches."""
    drawn = stored(_sketches_of(signed, _ends(pairs), options), "sketches")
    left, right = drawn.toDF("a", "size_a", "sketch_a"), drawn.toDF("b", "size_b", "sketch_b")
    met = pairs.select("a", "b").join(right, "b").join(left, "a")
    return met.where(_near("size_a", "size_b", "sketch_a", "sketch_b", options)).select("a", "b")


def _possible(small: str, large: str, options: JaccardOptions) -> Column:
    """Whether sizes and shared prefixes of two classes allow a link.

    Of two heavy sets, the shingles they have in common are at most the shared ones of either
    prefix and all behind the prefix of one of them.
    """
    p = options.percent
    return F.expr(
        f"100 * {small}.n >= {p} * {large}.n AND (100 + {p}) * (least({small}.shared, {large}.shared) + "
        f"greatest({small}.rest, {large}.rest)) >= {p} * ({small}.n + {large}.n)"
    )


def _placed(lists: DataFrame, light: int, options: JaccardOptions) -> DataFrame:
    """The lists with ``shared`` (prefix shingles of the class that are in lists), ``rest`` (those behind the prefix) and ``head``.

    A light class isn't in all lists of its prefix, so nothing is concluded from what it shares. ``head`` is
    the best covered class of the list, or of this part of it.
    """
    p = options.percent
    partner = f"(({p} * n + 99) div 100)"
    prefix = f"(n - (({p} * (n + {partner}) + {99 + p}) div {100 + p}) + 1)"
    shared = lists.groupBy("set_id").agg(F.count("*").cast("int").alias("lists"))
    # Dealt with the few columns from which the others are made.
    dealt = lists.join(shared, "set_id").repartition("key", "part")
    placed = dealt.selectExpr(
        "key", "part", "set_id", "n", "tag", "length",
        f"CASE WHEN n <= {light} THEN n ELSE least(lists, {prefix}) END AS shared",
        f"CASE WHEN n <= {light} THEN n ELSE n - {prefix} END AS rest",
    )
    me = F.struct(((F.col("shared") + F.col("rest")) / F.col("n")).alias("share"), "set_id", "n", "shared", "rest")
    return placed.withColumn("head", F.max(me).over(Window.partitionBy("key", "part")))


def set_links(docs: DataFrame, signed: DataFrame, options: JaccardOptions) -> DataFrame:
    """(a, b): enough linked classes to connect all that are linked, directly or through others."""
    classes = signed.where("set_id IS NOT NULL").select("set_id", "n_shingles").distinct()
    counted = stored(_counted(docs, options), "shingle-counts")
    often = (
        counted.where("NOT small").orderBy(F.desc("count"), "shingle").limit(options.frequent).select("shingle", "count").toArrow()
    )
    lists = counted.where("small").agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    few = classes.where(F.col("n_shingles") <= options.light_limit).groupBy("n_shingles").count().collect()  # a row for each size
    light = boundary({r[0]: r[1] for r in few}, lists[0] / lists[1] if lists[1] else 0.0, options)
    order = _Order(often["shingle"].to_numpy().view(_U), often["count"].to_numpy(), light)

    lists = stored(_shared_lists(_postings(docs, order, options)), "lists")
    full = stored(_placed(lists, light, options), "placed")

    # Every class with the best covered one of its list, the parts of a long list with each other's best.
    parted = full.where("part >= 0 AND set_id = head.set_id").select("key", "head")  # a head is in its list once
    top = parted.groupBy("key").agg(F.max("head").alias("top"))
    tops = top.join(parted, "key")
    ranked = full.select(F.struct("set_id", "n", "shared", "rest").alias("x"), F.col("head").alias("y"))
    stars = (
        ranked.unionByName(tops.select(F.struct("head.set_id", "head.n", "head.shared", "head.rest").alias("x"), F.col("top").alias("y")))
        .where("x.set_id <> y.set_id")
        .where((F.expr("x.n <= y.n") & _possible("x", "y", options)) | (F.expr("x.n > y.n") & _possible("y", "x", options)))
        .select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
        .distinct()
    )
    stars = stored(stars, "stars")
    near = stored(_sifted(stars, signed, options), "near")
    links = stored(_linked(near, stored(_sets_of(docs, signed, _ends(near), options), "sets"), options), "linked")

    # What the stars left apart: classes of different components that share a list. A list of two had its only pair among the stars.
    known = stored(components(links), "parts")
    longer = full.where("length > 2 OR part >= 0").select("key", "part", "set_id", "n", "tag", "length", "shared", "rest", F.col("head.set_id").alias("head"))
    apart = longer.join(known.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    split = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    top = top.select("key", F.col("top.set_id").alias("top"))
    apart = stored(apart.join(split, "key").join(top, "key", "left").withColumn("head", F.coalesce("top", "head")).drop("top"), "apart")
    # The classes of crowds bring short sketches along, so that few of a crowd's pairs are written at all.
    crowd = apart.where((F.col("length") >= options.crowd) | (F.col("part") >= 0)).select("set_id").distinct()
    drawn = stored(_sketches_of(signed, crowd, options).select("set_id", F.expr(shortened("sketch", 8)).alias("sketch")), "crowd")
    # Lists with one head hold much the same classes: their classes are compared once, under the head.
    able = (
        apart.groupBy("head", "set_id")
        .agg(*[F.first(c).alias(c) for c in ("n", "shared", "rest", "component")], F.max("tag").alias("tag"))
    )
    able = stored(able.join(drawn, "set_id", "left"), "able")
    pairs = (
        able.alias("s")
        .join(
            able.alias("l"),
            F.expr("s.head = l.head AND s.tag AND s.component <> l.component AND (s.n < l.n OR s.n = l.n AND s.set_id < l.set_id)")
            & _possible("s", "l", options)
            & F.expr(_near("s.n", "l.n", "s.sketch", "l.sketch", options)),
        )
        .select(F.least("s.set_id", "l.set_id").alias("a"), F.greatest("s.set_id", "l.set_id").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    near = stored(_sifted(stored(pairs, "pairs"), signed, options), "near")
    return links.unionByName(_linked(near, stored(_sets_of(docs, signed, _ends(near), options), "sets"), options))


def _classes(docs: DataFrame, options: JaccardOptions) -> tuple[DataFrame, DataFrame]:
    """signatures of all rows; and (of_set, component, first_id) of every class, component: a set_id."""
    signed = stored(signatures(docs, options), "signatures")
    linked = settled(lambda: components(set_links(docs, signed, options)), "components")
    classes = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    named = classes.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
    return signed, stored(
        named.select(F.col("set_id").alias("of_set"), F.coalesce("component", "set_id").alias("component"), "first_id"), "classes"
    )


def jaccard_components(docs: DataFrame, options: JaccardOptions | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    signed, classes = _classes(docs, options or JaccardOptions())
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(classes.join(least, "component").select("of_set", "component_id"), "named")
    alone = signed.where("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        signed.where("set_id IS NOT NULL").join(named, F.col("set_id") == F.col("of_set"))
        .select("doc_id", "n_shingles", "component_id").unionByName(alone)
    )


def _affected(docs: DataFrame, options: JaccardOptions) -> DataFrame:
    """(_content, _id, _chosen) of the rows in components of several rows; _chosen: this one stays."""
    signed, classes = _classes(docs, options)
    known = signed.where("set_id IS NOT NULL").join(classes, F.col("set_id") == F.col("of_set"))
    chosen = known.groupBy("component").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "content")).alias("one"))
    several = stored(chosen.where("rows > 1").select(F.col("component").alias("of"), "one"), "several")
    return known.join(several, F.col("component") == F.col("of")).select(
        F.col("content").alias("_content"), F.col("doc_id").alias("_id"),
        ((F.col("one.content") == F.col("content")) & F.col("one.doc_id").eqNullSafe(F.col("doc_id"))).alias("_chosen"),
    ).distinct()


def one_of_each(docs: DataFrame, options: JaccardOptions | None = None) -> DataFrame:
    """One row of each component, that with the smallest id (then content), and all rows without words; all columns.

    Only rows whose content is in a component of several rows, and those that a bitmap of fixed
    size takes for such, are shuffled.
    """
    options = options or JaccardOptions()
    affected = settled(lambda: _affected(docs, options), "affected")
    sieve = F.broadcast(_sieve(affected, "_content", options.sieve_bits)).toDF("_word", "_mask")
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    bit = F.pmod(F.col("_hash"), F.lit(options.sieve_bits))
    sifted = keyed.join(sieve, F.floor(bit / 64).cast("int") == F.col("_word"), "left")
    hit = F.coalesce(F.expr("_mask & shiftleft(1L, CAST(pmod(_hash, 64) AS INT)) <> 0"), F.lit(False)) & F.col("text").isNotNull()
    same = (F.col("_hash") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    hits = sifted.where(hit).join(affected, same, "left").where("_chosen IS NULL OR _chosen")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text" and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    place = F.row_number().over(Window.partitionBy("_hash", "doc_id").orderBy(*others))
    first = hits.withColumn("_place", place).where("_chosen IS NULL OR _place = 1")
    return sifted.where(~hit).select(*docs.columns).unionByName(first.select(*docs.columns))
