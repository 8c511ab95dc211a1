"""Ranked lexical search by two trees: the best documents for each item, exactly.

Items and documents are sparse vectors over terms whose product is the score: an item's coordinate is its
term's weight times its repeats, a document's the saturated frequency of the term. The items of a
block form a tree, and so do the documents of a shard, which a task fills as it reads: neighbours share
their strongest term, and a node holds the maximum of each coordinate over all below it. The product
of two nodes bounds every score between their rows. A pair of nodes whose bound is less than the
weakest kth score of the node's items is dropped with all pairs below it; else the documents' node
is opened, then the items' one, down to leaves, where scores are taken exactly in 64-bit integers. Bounds only save
work: no document that belongs to a list is lost.

A first run over a part of the documents gives each item a kth score to start from; each task then
raises its own. A task keeps k documents an item at most, whatever the number of equal scores, and lists of tasks are merged in two
steps. Items are searched in blocks of bounded size, one at a time on the driver and in the tasks.

Terms are maximal runs of digits, letters and characters beyond ASCII, with A-Z lower-cased, told apart by
64-bit hashes.

Defined results: a null text has no terms; an item or document without terms ranks nowhere. Repeated
items are answered each, repeated documents ranked each. Equal scores go by doc_id, nulls last. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idcordon.llm.words import blocks, split, word_hashes
from idcordon.sources.shared import stored

_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchOptions:
    """vocabulary: most item terms to be sent to tasks so that only these are stored of documents; with more, all
    terms are stored. block: terms of the items searched at once, and shard: terms of the documents in
    one tree, but one row at least. first: documents of the first run, about."""

    k: int = 20
    vocabulary: int = 1 << 20
    block: int = 1 << 18
    shard: int = 1 << 19
    fan: int = 4
    first: int = 20_000


def term_rows(df: DataFrame, key: str, text: str = "text", only: np.ndarray | None = None) -> DataFrame:
    """(key, n, terms, counts): the number of terms, and the distinct ones with their repeats as 64- and 32-bit integers.

    ``only``: sorted hashes of the terms that are kept in ``terms``; n counts all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = split(block, _GAPS)
                hashes = word_hashes(block, words)
                total = np.diff(words.first)
                text = words.text
                if only is not None:
                    there = _among(only, hashes)
                    hashes, text = hashes[there], text[there]
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                starts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]) if len(hashes) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[starts, len(hashes)]).astype("<u4")
                hashes = hashes[starts].astype("<u8")
                cuts = np.searchsorted(text[starts], np.arange(block.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(total.astype("i8")),
                     pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["key", "n", "terms", "counts"],
                )

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    return df.select(key, text).mapInArrow(count, schema)


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def document_counts(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """(term, df): the number of rows that hold each term, summed in the task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = np.concatenate([np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()] or [np.zeros(0, "<u8")])
            if only is not None:
                terms = terms[_among(only, terms)]
            term, n = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view("i8")), pa.array(n.astype("i8"))], names=["term", "df"])

    return rows.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Level:
    """Nodes of one height as postings by term: ``start[t]:start[t + 1]`` are those of term t."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int) -> None:
        order = np.lexsort((term, node))
        node, term, value = node[order], term[order], value[order]
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.zeros(0, np.int64)
        self.n, self.terms = n, terms
        self.node, self.term = node[first], term[first]
        self.value = np.maximum.reduceat(value, first) if len(first) else value
        self.cut = np.searchsorted(self.node, np.arange(n + 1))  # rows of each node
        by = np.argsort(self.term, kind="stable")
        self.post_node, self.post_value = self.node[by], self.value[by].astype(np.float64)
        self.start = np.searchsorted(self.term[by], np.arange(terms + 1))

    def above(self, fan: int) -> Level:
        return Level(self.node // fan, self.term, self.value, -(-self.n // fan), self.terms)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.cut[i], self.cut[i + 1])
        return self.term[own], self.value[own]

    def bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The product of a vector with each node."""
        a, b = self.start[term], self.start[term + 1]
        size = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.bincount(self.post_node[at], self.post_value[at] * np.repeat(value, size), self.n)


def strongest(node: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """An order of rows in which those with the same strongest term stand together."""
    best = np.full(n, -1, dtype=np.int64)
    by = np.lexsort((term, value, node))
    last = np.flatnonzero(np.r_[node[by][1:] != node[by][:-1], True]) if len(by) else by
    best[node[by][last]] = term[by][last]
    return np.argsort(best, kind="stable")


class Tree:
    """Levels from the rows up to one node; row i of the lowest one is row ``order[i]``."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int, fan: int) -> None:
        self.order = strongest(node, term, value, n)
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        self.levels = [Level(place[node], term, value, n, terms)]
        while self.levels[-1].n > 1:
            self.levels.append(self.levels[-1].above(fan))
        self.fan = fan


class Items:
    """A block of items: their tree and vocabulary."""

    def __init__(self, rows: list[tuple[bytes, bytes]], weights: dict[int, int], options: SearchOptions) -> None:
        terms = [np.frombuffer(t, "<u8") for t, _ in rows]
        counts = [np.frombuffer(c, "<u4").astype(np.int64) for _, c in rows]
        node = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
        term = np.concatenate(terms)
        weight = np.array([weights.get(x, 0) for x in term.tolist()], dtype=np.int64) * np.concatenate(counts)
        node, term, weight = node[weight > 0], term[weight > 0], weight[weight > 0]
        self.vocabulary, local = np.unique(term, return_inverse=True)
        self.n, self.options = len(rows), options
        self.tree = Tree(node, local, weight, len(rows), len(self.vocabulary), options.fan)


class Search:
    """The lists of one task: scores and documents of each item, in the order of the items' leaves."""

    def __init__(self, items: Items, floor: np.ndarray) -> None:
        self.items, self.k = items, items.options.k
        order = items.tree.order
        self.score = np.zeros((items.n, self.k), dtype=np.int64)
        self.doc = np.full((items.n, self.k), -1, dtype=np.int64)  # number of the document in the task
        self.floor = floor[order]  # a kth score that is known to be reached
        self.kept: list = []  # ids by number
        self.opened = self.compared = 0

    def weakest(self) -> np.ndarray:
        return np.maximum(self.floor, self.score.min(axis=1))

    def shard(self, ids: list, lengths: np.ndarray, rows: list[tuple[bytes, bytes]], n_all: int, length_all: int) -> None:
        """Search a shard; documents come in order of id, so that of equal scores the earlier one stays."""
        items = self.items
        term = np.concatenate([np.frombuffer(t, "<u8") for t, _ in rows])
        count = np.concatenate([np.frombuffer(c, "<u4") for _, c in rows]).astype(np.int64)
        node = np.repeat(np.arange(len(rows)), [len(t) // 8 for t, _ in rows])
        if not len(items.vocabulary):
            return
        at = np.minimum(np.searchsorted(items.vocabulary, term), len(items.vocabulary) - 1)
        there = items.vocabulary[at] == term
        node, at, count = node[there], at[there], count[there]
        m = 75 + (25 * lengths * n_all) // max(length_all, 1)
        value = (1_000_000_000 * count) // (1000 * count + 12 * m[node])
        tree = Tree(node, at, value, len(rows), len(items.vocabulary), items.options.fan)
        ranks = len(self.kept) + np.arange(len(rows))
        self.kept += ids
        self._descend(tree, len(tree.levels) - 1, 0, len(items.tree.levels) - 1, np.zeros(1, dtype=np.int64), ranks)

    def _descend(self, docs: Tree, height: int, i: int, level: int, nodes: np.ndarray, ranks: np.ndarray) -> None:
        """Documents' node i at ``height`` against items' ``nodes`` at ``level``."""
        fan, top = docs.fan, self.items.tree
        while True:
            term, value = docs.levels[height].row(i)
            bound = top.levels[level].bounds(term, value)[nodes]
            width = fan**level
            weakest = np.minimum.reduceat(self.weakest(), np.arange(0, self.items.n, width))[nodes]
            nodes = nodes[(bound > 0) & (bound * (1 + 1e-9) >= weakest)]
            self.opened += len(bound)
            if not len(nodes):
                return
            if level == (0 if height <= 1 else min(height, len(top.levels) - 1)):
                break
            level -= 1  # open the items' nodes down to the documents' height, over a leaf down to items
            below = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = below[below < top.levels[level].n]
        if height <= 1:
            self._compare(docs, i, height, nodes, ranks)
            return
        for child in range(i * fan, min((i + 1) * fan, docs.levels[height - 1].n)):
            self._descend(docs, height - 1, child, level, nodes, ranks)

    def _compare(self, docs: Tree, i: int, height: int, items: np.ndarray, ranks: np.ndarray) -> None:
        """Exact scores of a documents' leaf with items, which come in ascending order."""
        fan, leaf = docs.fan, docs.levels[0]
        own = range(i * fan, min((i + 1) * fan, leaf.n)) if height else range(i, i + 1)
        part = slice(leaf.cut[own[0]], leaf.cut[own[-1] + 1])
        terms, at = np.unique(leaf.term[part], return_inverse=True)
        matrix = np.zeros((len(terms), len(own)), dtype=np.int64)
        matrix[at, leaf.node[part] - own[0]] = leaf.value[part]
        number = ranks[docs.order[own[0] : own[-1] + 1]]
        weakest = self.weakest()
        for item in items.tolist():
            t, weight = self.items.tree.levels[0].row(item)
            place = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            hit = terms[place] == t
            scores = weight[hit] @ matrix[place[hit]]
            self.compared += len(own)
            if (best := scores.max()) >= weakest[item] and best > 0:
                self._insert(item, scores, number, weakest[item])

    def _insert(self, item: int, scores: np.ndarray, number: np.ndarray, least: int) -> None:
        new = (scores >= least) & (scores > 0)
        score = np.r_[self.score[item], scores[new]]
        doc = np.r_[self.doc[item], number[new]]
        best = np.lexsort((self.ids_rank(doc), -score))[: self.k]
        self.score[item], self.doc[item] = score[best], doc[best]

    def ids_rank(self, doc: np.ndarray) -> np.ndarray:
        """Ids of numbered documents as integers that order them; places without a document come last."""
        return np.array([_NONE if d < 0 else self.kept[d] for d in doc.tolist()], dtype=np.int64)

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(item, document's number, score)."""
        for row, item in enumerate(self.items.tree.order.tolist()):
            for score, doc in zip(self.score[row].tolist(), self.doc[row].tolist()):
                if doc >= 0 and score >= self.floor[row]:
                    yield item, doc, score


def _run(docs: DataFrame, items: Items, floor: np.ndarray, n_all: int, length_all: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each item of the block."""
    options = items.options

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, floor)
        ids, lengths, rows, size = [], [], [], 0

        def flush() -> None:
            if rows:
                search.shard(ids, np.array(lengths, dtype=np.int64), rows, n_all, length_all)

        for batch in batches:
            for key, n, terms, counts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if rows and size + len(terms) // 8 > options.shard:
                    flush()
                    ids, lengths, rows, size = [], [], [], 0
                ids.append(_NONE if key is None else key)
                lengths.append(n)
                rows.append((terms, counts))
                size += len(terms) // 8 + 1
        flush()
        found = list(search.found())
        item, doc, score = (list(x) for x in zip(*found)) if found else ([], [], [])
        own = [search.kept[d] for d in doc]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([None if x == _NONE else x for x in own], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"]
        )

    return docs.select("key", "n", "terms", "counts").where("n > 0").mapInArrow(work, "item int, doc_id bigint, score bigint")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item with ``rank``; lists are merged by parts of an item first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = found.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    return some.drop("part", "r").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(documents: DataFrame, queries: DataFrame, options: SearchOptions | None = None, item: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item; doc_id is an integer."""
    options = options or SearchOptions()
    spark = documents.sparkSession
    asked = stored(term_rows(queries, item).where("n > 0").withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.expr("length(terms) div 8")), "items")
    kind = asked.schema["key"].dataType.simpleString()
    empty = spark.createDataFrame([], f"{item} {kind}, rank int, doc_id bigint, score bigint")
    entries = asked.agg(F.sum("size")).first()[0]
    if not entries:
        return empty
    only = None
    if entries <= options.vocabulary:
        only = np.unique(np.concatenate([np.frombuffer(r.terms, "<u8") for r in asked.select("terms").toLocalIterator()]))
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs = stored(term_rows(documents, "doc_id", only=only), "terms")
    n_all, length_all = docs.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_all:
        return empty
    counts = stored(document_counts(docs, only), "term-counts")
    parts = -(-entries // options.block)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    share = min(1.0, options.first / n_all)
    out = None
    for part in range(parts):  # a block at a time: the items' tree, then two runs over the documents
        own = asked.where(F.col("part") == part).orderBy("row").select("row", "key", "terms", "counts").collect()
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([np.frombuffer(r.terms, "<u8") for r in own])).view("i8")
        wanted = spark.createDataFrame([(x,) for x in vocabulary.tolist()], "term bigint")
        known = counts.join(F.broadcast(wanted), "term").collect()  # as many as the block has terms
        weights = {r.term % (1 << 64): math.floor(1000 * math.log((2 * n_all + 2) / (2 * r.df + 1))) for r in known}
        items = Items([(r.terms, r.counts) for r in own], weights, options)
        floor = np.zeros(items.n, dtype=np.int64)
        if share < 0.5:
            some = docs.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
            for r in _merged(_run(some, items, floor, n_all, length_all), options.k).where(F.col("rank") == options.k).collect():
                floor[r.item] = r.score
        best = stored(_merged(_run(docs, items, floor, n_all, length_all), options.k), "ranked")
        names = spark.createDataFrame([(i, r.key) for i, r in enumerate(own)], f"item int, {item} {kind}")
        best = best.join(F.broadcast(names), "item").select(item, "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return empty if out is None else out
