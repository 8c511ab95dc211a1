"""Benchmark decontamination: n-gram seeds, then local alignment.

Words are lower-cased runs of letters, digits and other non-ASCII characters; punctuation
counts as space. Every n-gram of a test item is a seed. The passage around a seed that a
document holds is as wide as an alignment at the threshold can be. Passages that hold too few
of the item's words to reach it are put aside (no alignment scores more than the words in
common give); the others are aligned with the item by Smith-Waterman over words. So each copy
that keeps ``n`` words in a row is found, whatever else is changed, left out or put in. The
score is the alignment's over that of an exact copy.

The benchmark is matched in slices of at most ``slice_bytes`` of text, each sent to all tasks;
the documents stay where they are, and nothing is shuffled. Every document is matched with
every item over its whole text.

Defined results: null and empty texts match nothing. Items of fewer than ``n`` words (or null)
can't be seeded and match nothing. Equal items are reported each. Repeated rows are matched
each. Extra columns are not read, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.llm import words as W

_U = np.uint64
_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class LeakOptions:
    """n: words of a seed. threshold: least share of an exact copy's score. slice_bytes: of benchmark text at once."""

    n: int = 3
    threshold: float = 0.5
    match: int = 2
    mismatch: int = 1
    gap: int = 1
    slice_bytes: int = 1 << 22


@dataclass(frozen=True)
class Items:
    """Words of the items laid end to end, and their n-grams."""

    ids: list
    first: np.ndarray
    words: np.ndarray
    grams: np.ndarray  # distinct hashes, sorted
    gram_of: np.ndarray  # (gram index, item, place in the item), sorted by gram index
    begin: np.ndarray  # where each gram's rows begin

    @classmethod
    def of(cls, ids: list, texts: list[str | None], n: int) -> Items:
        first, words = word_values(pa.array(texts, pa.string()))
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        value, place = grams(words, owner, n)
        known, index = np.unique(value, return_inverse=True)
        order = np.argsort(index, kind="stable")
        rows = np.column_stack([index[order], owner[place[order]], place[order] - first[owner[place[order]]]])
        return cls(ids, first, words, known, rows, np.searchsorted(rows[:, 0], np.arange(len(known) + 1)))


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text and the number of words, hashes of all words)."""
    first, values, total = [np.zeros(1, dtype=np.int64)], [], 0
    for block in W.blocks(pc.utf8_lower(texts)):
        words = W.split(block, _GAPS)
        values.append(W.word_hashes(block, words))
        first.append(words.first[1:] + total)
        total += len(words.starts)
    return np.concatenate(first), np.concatenate(values) if values else np.zeros(0, dtype=_U)


def grams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the n-grams that lie inside one text."""
    value = W.gram_hashes(words, n)
    place = np.flatnonzero(owner[: len(value)] == owner[n - 1 :][: len(value)]) if len(value) else np.zeros(0, dtype=np.int64)
    return value[place], place


# ---------------------------------------------------------------- alignment


def align(items: list[np.ndarray], passages: list[np.ndarray], options: LeakOptions) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the place in the passage where it ends; all pairs in step."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), rows), dtype=_U)
    b = np.zeros((len(items), cols), dtype=_U)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    real_a, real_b = (np.arange(rows) < np.array([len(x) for x in items])[:, None]), (np.arange(cols) < np.array([len(y) for y in passages])[:, None])
    slope = np.arange(cols, dtype=np.int32) * options.gap
    before = np.zeros((len(items), cols + 1), dtype=np.int32)
    best, end = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int64)
    for i in range(rows):
        gain = np.where((b == a[:, i : i + 1]) & real_b & real_a[:, i : i + 1], options.match, -options.mismatch).astype(np.int32)
        now = np.maximum(np.maximum(before[:, :-1] + gain, before[:, 1:] - options.gap), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        before[:, 1:] = now
        top = now.max(axis=1)
        better = top > best
        end[better] = now[better].argmax(axis=1)
        best = np.maximum(best, top)
    return best, end


class Matcher:
    """Finds the items of a slice in texts."""

    def __init__(self, items: Items, options: LeakOptions) -> None:
        self.items, self.options = items, options
        self.table = W.Table(items.grams)
        self.size = np.diff(items.first)
        known, word = np.unique(items.words, return_inverse=True)
        self.words, self.known = W.Table(known), len(known)
        owner = np.repeat(np.arange(len(items.ids)), self.size)
        pairs, self.times = np.unique(owner * self.known + word, return_counts=True)
        self.pairs = W.Table(W.mix64(pairs.astype(_U)))  # item and word, with how often it has it
        # So many words can be put in at most before a copy falls below the threshold.
        self.slack = (self.size * options.match * max(0.0, 1 - options.threshold) / max(1, options.gap) + 1e-9).astype(np.int64)

    def leaks_of(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, from word, to word) of the pairs at or above the threshold."""
        for block in W.blocks(pc.utf8_lower(texts)):
            words = W.split(block, _GAPS)
            value = W.word_hashes(block, words)
            hash_, place = grams(value, words.text, self.options.n)
            at = self.table.find(hash_)
            hit = np.flatnonzero(at >= 0)
            if not len(hit):
                continue
            id_ = self.words.find(value)
            found = [self._passages(words, id_, place[hit[some]], at[hit[some]]) for some in self._parts(self._times(at[hit]), 1 << 18)]
            text, item, lo, hi = (np.concatenate(c) for c in zip(*found))
            if len(text):
                yield from _best(block, words, value, self.items, text, item, lo, hi, self.options)

    def _times(self, gram: np.ndarray) -> np.ndarray:
        return self.items.begin[gram + 1] - self.items.begin[gram]

    @staticmethod
    def _parts(weights: np.ndarray, limit: int) -> list[np.ndarray]:
        """Places in runs of at most ``limit`` of weight, or of one place if that is heavier."""
        run = np.cumsum(weights) // limit
        return np.split(np.arange(len(weights)), np.flatnonzero(np.diff(run)) + 1)

    def _passages(self, words: W.Words, id_: np.ndarray, where: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, from, to) of the passages around the seeds that could reach the threshold."""
        times = self._times(gram)
        entry = self.items.gram_of[np.repeat(self.items.begin[gram] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        where, item = np.repeat(where, times), entry[:, 1]
        start = where - entry[:, 2]
        text = words.text[where]
        order = np.lexsort((start, item, text))  # seeds of one diagonal have the same passage
        text, item, start = text[order], item[order], start[order]
        new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1]))
        text, item, start = text[new], item[new], start[new]
        lo = np.maximum(words.first[text], start - self.slack[item])
        hi = np.minimum(words.first[text + 1], start + self.size[item] + self.slack[item])
        common = [self._common(id_, item[some], lo[some], hi[some]) for some in self._parts(hi - lo, 1 << 21)]
        able = np.concatenate(common) >= self.options.threshold * self.size[item] - 1e-9
        return text[able], item[able], lo[able], hi[able]

    def _common(self, id_: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words that each passage and its item have in common, repeated ones as often as both have them."""
        length = hi - lo
        owner = np.repeat(np.arange(len(lo)), length)
        word = id_[np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        owner, word = owner[word >= 0], word[word >= 0]
        slot = self.pairs.find(W.mix64((item[owner] * self.known + word).astype(_U)))
        owner, slot = owner[slot >= 0], slot[slot >= 0]
        each, n = np.unique(owner * len(self.times) + slot, return_counts=True)
        return np.bincount(each // len(self.times), weights=np.minimum(n, self.times[each % len(self.times)]), minlength=len(lo))


def _best(block: W.Block, words: W.Words, value: np.ndarray, items: Items, text: np.ndarray, item: np.ndarray,
          lo: np.ndarray, hi: np.ndarray, options: LeakOptions) -> Iterator[tuple[int, int, float, int, int]]:
    """Passages that overlap are one; of all passages of a text and an item the best counts."""
    order = np.lexsort((lo, item, text))
    text, item, lo, hi = text[order], item[order], lo[order], hi[order]
    pair = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
    group = np.cumsum(pair) - 1
    far = np.maximum.accumulate(hi + group * np.int64(1 << 40)) - group * np.int64(1 << 40)
    fresh = pair.copy()
    fresh[1:] |= lo[1:] > far[:-1]
    head = np.flatnonzero(fresh)
    end = np.maximum.reduceat(hi, head)
    text, item, lo, group = text[head], item[head], lo[head], group[head]
    best: dict[int, tuple[int, int, float, int, int]] = {}
    by_size = np.argsort(end - lo, kind="stable")
    step, k = 0, 0
    while k < len(by_size):
        longest = int((end - lo)[by_size[min(k + 255, len(by_size) - 1)]])
        step = max(1, min(256, (1 << 18) // max(1, longest)))
        some = by_size[k : k + step]
        k += step
        own = [items.words[items.first[i] : items.first[i + 1]] for i in item[some]]
        points, stop = align(own, [value[a:b] for a, b in zip(lo[some], end[some])], options)
        for j, p, s, o in zip(some.tolist(), points.tolist(), stop.tolist(), own):
            share = p / (options.match * len(o))
            if share >= options.threshold and share > best.get(int(group[j]), (0, 0, 0.0))[2]:
                to = int(lo[j]) + s + 1 - int(words.first[text[j]])
                best[int(group[j])] = (block.first + int(text[j]), int(item[j]), share, max(0, to - len(o)), to)
    yield from best.values()


# ---------------------------------------------------------------- over the corpus


def _slices(benchmark: DataFrame, options: LeakOptions) -> list[Items]:
    """The items in slices of bounded size, each read by itself."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // options.slice_bytes) or 1
    out = []
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").select("item_id", "text").toArrow()
        out.append(Items.of(part["item_id"].to_pylist(), part["text"].to_pylist(), options.n))
    return [s for s in out if len(s.grams)]


def leaks(docs: DataFrame, benchmark: DataFrame, options: LeakOptions | None = None) -> DataFrame:
    """doc_id, item_id, score, from_word and to_word: documents and the items they hold; a row for each pair."""
    options = options or LeakOptions()
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    kinds = f"doc_id {doc_kind}, item_id {item_kind}, score double, from_word int, to_word int"
    out = docs.sparkSession.createDataFrame([], kinds)
    for items in _slices(benchmark, options):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            matcher = Matcher(items, options)
            arrow = [pa.string() if item_kind == "string" else pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            for b in batches:
                found = list(matcher.leaks_of(b["text"]))
                doc = b["doc_id"].take(pa.array([x[0] for x in found], pa.int64()))
                rest = [[items.ids[x[1]] for x in found], *([x[k] for x in found] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(
                    [doc, *(pa.array(c, t) for c, t in zip(rest, arrow))], names=["doc_id", "item_id", "score", "from_word", "to_word"]
                )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, kinds))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, options: LeakOptions | None = None) -> DataFrame:
    """The rows that hold no item, all columns."""
    options = options or LeakOptions()
    for items in _slices(benchmark, options):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, options)
            for b in batches:
                keep = np.ones(len(b), dtype=bool)
                keep[[x[0] for x in matcher.leaks_of(b["text"])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
