"""Removal of long repeats with a run-length compressed index.

A byte goes when a string of ``length`` bytes covers it that also starts anywhere else in the
corpus. Strings lie inside one text; equal texts repeat each other.

*Finding partners.* Every window of ``length`` bytes names its anchor: the k-mer inside it
whose hash is least, leftmost if tied. Equal windows name equal anchors, so only windows whose
anchor occurs twice in the corpus can repeat. Anchors that follow one another share a label
(the least hash nearby, the same for all places of an anchor), and the bytes of a run of
windows with one label form a segment. Equal windows are in segments of one label.

*Index.* The distinct segments of some labels are sorted by suffix. Of the Burrows-Wheeler
transform only the runs are kept: for the first and the last suffix of each run, its place and
the length of its match with the neighbour outside the run. Inside a run that length falls by
one from each place in the text to the next, so streaming once over the text gives the longest
match of every suffix with any other: its matching statistic. Windows with a statistic of at
least ``length`` are marked.

A label with more than ``label_bytes`` in its segments (thousands of near copies, or a passage
in very many texts) would be too much for one task. Its windows are compared by their hashes,
which spread over all tasks; the result is as exact (64-bit hashes of windows with equal
anchors).

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; repeated rows
are repeats of each other. Ids are not used, except to read one of several equal texts. Extra
columns are kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from idcordon.llm import words as W
from idcordon.llm.sieve import sifted
from idcordon.sources.shared import settled, stored

_U = np.uint64
_KEY = ["h1", "h2"]  # a text: two independent hashes


@dataclass(frozen=True)
class RepeatOptions:
    """length: of a repeat, bytes. anchor: bytes of an anchor. near: anchors on either side whose least hash is the label.

    sieve_bits: of the bitmap that spares texts without repeats a shuffle.
    """

    length: int = 400
    anchor: int = 200
    near: int = 12
    label_bytes: int = 1 << 22
    index_bytes: int = 1 << 20
    sieve_bits: int = 1 << 24


# ---------------------------------------------------------------- anchors


def window_anchors(data: np.ndarray, offsets: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of the anchors of all windows of texts laid end to end."""
    none = (np.zeros(0, dtype=_U),) + tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    n, span = len(data), length - k + 1
    if n < length:
        return none
    sums = W.prefix_hash(data, fold=False)
    _, inverse = W.powers(n)
    value = W.mix64((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1] + _U(k))
    bits = max(1, int(n).bit_length())
    low = _U((1 << bits) - 1)
    ranked = (value & ~low) | np.arange(len(value), dtype=_U)
    least = sliding_least(ranked, span)[: n - length + 1]
    inside = np.zeros(n - length + 1, dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    windows = np.flatnonzero(inside)
    if not len(windows):
        return none
    place = (least[windows] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    last = np.append(first[1:], len(windows)) - 1
    return value[place[first]], place[first], windows[first], windows[last]


def nth(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    new = np.flatnonzero(np.diff(values[order], prepend=~values[order[:1]]) != 0)
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(values)) - np.repeat(new, np.diff(new, append=len(values)))
    return out


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of x[i : i + span] for every i; places beyond the end count as large."""
    pad = -len(x) % span + span
    full = np.concatenate([x, np.full(pad, np.iinfo(_U).max, dtype=_U)]).reshape(-1, span)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x)], ahead[span - 1 : span - 1 + len(x)])


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(F.lit(7), text))


def _anchors(hashed: DataFrame, options: RepeatOptions) -> DataFrame:
    """(anchor, part, h1, h2, place, first, last) of every distinct text; a text comes from each task that has it.

    part: 0 for an anchor's first two places in a block of texts, by which all tasks know that it occurs twice; the others are spread by text.
    """
    names = ["anchor", "part", *_KEY, "place", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keys = list(zip(b["h1"].to_pylist(), b["h2"].to_pylist()))
            fresh = pa.array([x not in seen and not seen.add(x) for x in keys], pa.bool_())
            h1, h2 = (b[c].filter(fresh).to_numpy() for c in _KEY)
            for block in W.blocks(b["text"].filter(fresh)):
                value, place, first, last = window_anchors(block.data, block.offsets, options.anchor, options.length)
                text = np.searchsorted(block.offsets, place, side="right") - 1
                start = block.offsets[text]
                part = np.where(nth(value) < 2, 0, h1[block.first + text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(part), pa.array(h1[block.first + text]), pa.array(h2[block.first + text]),
                     *[pa.array((x - start).astype(np.int32)) for x in (place, first, last)]],
                    names=names,
                )

    kinds = "anchor long, part long, h1 long, h2 long, place int, first int, last int"
    return hashed.select(*_KEY, "text").mapInArrow(run, kinds)


def _repeated(anchors: DataFrame) -> DataFrame:
    """Each place of a distinct text once, if its anchor occurs twice; all anchors are shuffled once, and frequent ones to many tasks."""
    once = anchors.repartition("anchor", "part").dropDuplicates(["anchor", "part", *_KEY, "place"])
    counted = once.withColumn("n", F.count("*").over(Window.partitionBy("anchor", "part")))
    again = counted.where("part <> 0 OR n > 1").drop("part", "n")
    return again.repartition(*_KEY).dropDuplicates([*_KEY, "place"])  # a text in two tasks may have one place in two parts


# ---------------------------------------------------------------- segments


def _segments(repeated: DataFrame, options: RepeatOptions) -> DataFrame:
    """(h1, h2, label, begin, end): bytes of runs of windows with one label."""
    order = Window.partitionBy(*_KEY).orderBy("place")
    nearby = order.rowsBetween(-options.near, options.near)
    labels = repeated.select("anchor", F.min("anchor").over(nearby).alias("label")).groupBy("anchor").agg(F.min("label").alias("label"))
    labels = stored(labels, "labels")
    labelled = repeated.join(labels, "anchor")
    before = F.lag(F.struct("label", "last")).over(order)
    fresh = before.isNull() | (before["label"] != F.col("label")) | (before["last"] + 1 != F.col("first"))
    return (
        labelled.withColumn("run", F.sum(fresh.cast("int")).over(order))
        .groupBy(*_KEY, "run")
        .agg(F.first("label").alias("label"), F.min("first").alias("begin"), (F.max("last") + options.length).alias("end"))
        .drop("run")
    )


def _bytes_of(hashed: DataFrame, segments: DataFrame, firsts: DataFrame, options: RepeatOptions) -> DataFrame:
    """(h1, h2, label, begin, hot, data): the bytes of each segment."""
    lists = segments.groupBy(*_KEY).agg(F.collect_list(F.struct("label", "begin", "end", "hot")).alias("segments"))
    wanted = lists.join(firsts, _KEY)  # a text has segments in proportion to its length
    likely, hit = sifted(hashed.select("doc_id", "text", *_KEY), "h1", segments, "h1", options.sieve_bits)
    texts = likely.where(hit)
    same = (texts["h1"] == wanted["h1"]) & (texts["h2"] == wanted["h2"]) & texts["doc_id"].eqNullSafe(wanted["the_id"])
    joined = texts.join(wanted, same).select(texts["h1"], texts["h2"], "text", "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for h1, h2, text, segs in zip(b["h1"].to_pylist(), b["h2"].to_pylist(), b["text"], b["segments"].to_pylist()):
                data = text.as_py().encode()
                for s in segs:
                    out.append((s["label"], h1, h2, s["begin"], s["hot"], data[s["begin"] : s["end"]]))
                    size += s["end"] - s["begin"]
                if size > 4 << 20:
                    yield _segment_batch(out)
                    out, size = [], 0
            if out:
                yield _segment_batch(out)

    return joined.mapInArrow(run, "label long, h1 long, h2 long, begin int, hot boolean, data binary")


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["label", *_KEY, "begin", "hot", "data"]
    )


# ---------------------------------------------------------------- index


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a text of symbols under 512 in order, by doubling; only tied suffixes are sorted again."""
    n = len(symbols)
    key = packed(symbols)
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])).astype(np.int32)
    del key
    size = np.diff(head, append=np.int32(n))
    rank[order] = np.repeat(head, size)
    depth = _PACK
    tied = np.repeat(size > 1, size)  # by place in the order
    at = np.flatnonzero(tied).astype(np.int32)
    while len(at):
        who = order[at]
        further = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)], np.int32(-1))
        group = rank[who]
        by = np.lexsort((further, group))
        who, further, group = who[by], further[by], group[by]
        order[at] = who
        new = np.append(True, (group[1:] != group[:-1]) | (further[1:] != further[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(head, append=len(who))
        rank[who] = np.repeat(at[head], size)
        at = at[np.repeat(size > 1, size)]
        depth *= 2
    return order


_PACK = 7


def packed(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each place on, as one number."""
    n = len(symbols)
    full = np.concatenate([symbols, np.zeros(_PACK, dtype=symbols.dtype)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(_PACK):
        key <<= 9
        key |= full[k : k + n]
    return key


@dataclass(frozen=True)
class RunIndex:
    """Ends of the runs of a Burrows-Wheeler transform.

    ``heads``, ``tails``: places of the first and last suffix of each run; ``above``, ``below``:
    lengths of their matches with the suffix before the head and after the tail.
    """

    n: int
    heads: np.ndarray
    above: np.ndarray
    tails: np.ndarray
    below: np.ndarray

    def statistics(self) -> np.ndarray:
        """For each place, the longest match of its suffix with another, in one pass over the text."""
        return np.maximum(self._streamed(self.heads, self.above), self._streamed(self.tails, self.below))

    def _streamed(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        sampled = np.zeros(self.n, dtype=np.int64)
        length = np.zeros(self.n, dtype=np.int64)
        sampled[places] = places
        length[places] = lengths
        last = np.maximum.accumulate(sampled)
        return np.maximum(0, length[last] - (np.arange(self.n) - last))


def build_index(symbols: np.ndarray) -> RunIndex:
    """``symbols``: bytes plus one, each segment followed by 0."""
    order = suffix_order(symbols)
    n = len(order)
    before = symbols[order - 1]
    before[order == 0] = -1  # nothing stands before the whole text: a run of its own
    change = before[1:] != before[:-1]
    first = np.flatnonzero(np.append(True, change))
    last = np.append(first[1:], n) - 1
    key = packed(symbols)
    above = np.zeros(len(first), dtype=np.int64)
    above[first > 0] = common_prefix(symbols, key, order[first[first > 0]], order[first[first > 0] - 1])
    below = np.zeros(len(last), dtype=np.int64)
    below[last < n - 1] = common_prefix(symbols, key, order[last[last < n - 1]], order[last[last < n - 1] + 1])
    return RunIndex(n, order[first], above, order[last], below)


def common_prefix(symbols: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the matches of the suffixes a[i] and b[i]."""
    n, out = len(symbols), np.zeros(len(a), dtype=np.int64)
    left, shift = np.arange(len(a)), 0
    while len(left):
        x, y = a[left] + shift, b[left] + shift
        ok = np.maximum(x, y) + _PACK <= n
        ok[ok] = key[x[ok]] == key[y[ok]]
        ended, left = left[~ok], left[ok]
        x, y = a[ended] + shift, b[ended] + shift
        equal, count = np.ones(len(ended), dtype=bool), np.zeros(len(ended), dtype=np.int64)
        for k in range(_PACK):
            there = np.maximum(x, y) + k < n
            equal &= there
            equal[equal] = symbols[x[equal] + k] == symbols[y[equal] + k]
            count += equal
        out[ended] = shift + count
        shift += _PACK
    return out


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different segments, which of its windows start elsewhere in them too."""
    starts, at = [], 0
    symbols = np.zeros(sum(map(len, segments)) + len(segments), dtype=np.int16)
    for s in segments:
        symbols[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
        symbols[at : at + len(s)] += 1
        starts.append(at)
        at += len(s) + 1
    marked = build_index(symbols).statistics() >= length
    return [marked[a : a + len(s) - length + 1] for a, s in zip(starts, segments)]


# ---------------------------------------------------------------- spans


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _indexed(segments: DataFrame, options: RepeatOptions) -> DataFrame:
    """(h1, h2, begin, end) covered by repeated windows, by run-length indexes over whole labels."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        owners: dict[bytes, list[tuple[int, int, int]]] = {}
        for _, h1, h2, begin, data in rows:
            owners.setdefault(data, []).append((h1, h2, begin))
        out: list[tuple[int, int, int, int]] = []
        for (data, who), mask in zip(owners.items(), repeated_windows(list(owners), options.length)):
            first, end = _runs(np.ones_like(mask) if len(who) > 1 else mask)
            for h1, h2, begin in who:
                out += [(h1, h2, begin + a, begin + b - 1 + options.length) for a, b in zip(first.tolist(), end.tolist())]
        return _span_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("label", *_KEY, "begin", "data"))):
                if size >= options.index_bytes and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield spans(rows)

    dealt = segments.select("label", *_KEY, "begin", "data").repartition("label").sortWithinPartitions("label")
    return dealt.mapInArrow(run, "h1 long, h2 long, begin int, end int")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*_KEY, "begin", "end"])


def _compared(segments: DataFrame, options: RepeatOptions) -> DataFrame:
    """The same for labels that are too large for a task: windows that share their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, begin, data in zip(*(b[c].to_pylist() for c in (*_KEY, "begin", "data"))):
                raw = np.frombuffer(data, dtype=np.uint8)
                value, place, _, _ = window_anchors(raw, np.array([0, len(raw)]), options.length, options.length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(np.full(len(value), h1)), pa.array(np.full(len(value), h2)),
                     pa.array((place + begin).astype(np.int32))],
                    names=["window", *_KEY, "begin"],
                )

    hot = segments.where("hot").mapInArrow(run, "window long, h1 long, h2 long, begin int")
    again = stored(hot.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "windows")
    order = Window.partitionBy(*_KEY).orderBy("begin")
    found = hot.join(again, "window").withColumn("run", F.col("begin") - F.row_number().over(order))
    return found.groupBy(*_KEY, "run").agg(F.min("begin").alias("begin"), (F.max("begin") + options.length).alias("end")).drop("run")


def repeat_spans(docs: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """(h1, h2, spans): for each text with repeats, the bytes to remove: [begin, end) in order, apart from each other."""
    return settled(lambda: _spans(docs, options or RepeatOptions()), "spans")


def _spans(docs: DataFrame, options: RepeatOptions) -> DataFrame:
    hashed = _hashed(docs)
    ids = hashed.select("doc_id", *_KEY, F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    copies = stored(
        ids.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.min("doc_id").alias("the_id"), F.first("n_bytes").alias("n_bytes")),
        "copies",
    )
    repeated = stored(_repeated(_anchors(hashed, options)), "repeated")
    plan = stored(_segments(repeated, options), "segments")
    large = plan.groupBy("label").agg(F.sum(F.col("end") - F.col("begin")).alias("size")).where(F.col("size") > options.label_bytes)
    large = stored(large.select("label", F.lit(True).alias("large")), "large")
    plan = plan.join(large, "label", "left").select(*_KEY, "label", "begin", "end", F.coalesce("large", F.lit(False)).alias("hot"))
    data = stored(_bytes_of(hashed, plan, copies.select(*_KEY, "the_id"), options), "bytes")
    whole = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= options.length)).select(
        *_KEY, F.lit(0).alias("begin"), F.col("n_bytes").cast("int").alias("end")
    )
    found = _indexed(data.where("NOT hot"), options).unionByName(_compared(data, options)).unionByName(whole)
    return found.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("raw")).select(*_KEY, _merged("raw"))


def _merged(column: str) -> Column:
    """Spans in order; those that touch are one."""
    return F.expr(
        f"aggregate(array_sort({column}), CAST(array() AS array<struct<begin: int, end: int>>), (all, s) -> "
        "CASE WHEN size(all) > 0 AND element_at(all, -1).end >= s.begin THEN concat(slice(all, 1, size(all) - 1), "
        "array(named_struct('begin', element_at(all, -1).begin, 'end', greatest(element_at(all, -1).end, s.end)))) "
        "ELSE concat(all, array(s)) END)"
    ).alias("spans")


def _with_spans(docs: DataFrame, options: RepeatOptions) -> DataFrame:
    spans = repeat_spans(docs, options).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "spans")
    rows, hit = sifted(_hashed(docs), "h1", spans, "s1", options.sieve_bits)
    met = rows.where(hit).join(spans, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
    others = rows.where(~hit).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    columns = [*docs.columns, "spans"]
    return met.select(*columns).unionByName(others.select(*columns))


def kept_bytes(data: bytes, spans: list[dict[str, int]] | None) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(data[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def removal_digests(docs: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    import hashlib

    options = options or RepeatOptions()
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, count, sha = [], [], [], []
            for text, spans in zip(b["text"], b["spans"].to_pylist()):
                data = (text.as_py() or "").encode()
                kept = kept_bytes(data, spans)
                n.append(len(data))
                removed.append(len(data) - len(kept))
                count.append(len(spans or ()))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(x, pa.int64()) for x in (n, removed, count)], pa.array(sha, pa.string())], names=names
            )

    joined = _with_spans(docs.select("doc_id", "text"), options).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """Every row with its repeats cut out of ``text``; n_removed: bytes cut. Half a character left by a cut goes too."""
    options = options or RepeatOptions()
    joined = _with_spans(docs, options)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for text, spans in zip(b["text"], b["spans"].to_pylist()):
                value = text.as_py()
                if spans:
                    data = value.encode()
                    value = kept_bytes(data, spans).decode(errors="ignore")
                    removed.append(sum(s["end"] - s["begin"] for s in spans))
                else:
                    removed.append(0)
                kept.append(value)
            values = [pa.array(kept, pa.string()) if name == "text" else b[name] for name in columns]
            yield pa.RecordBatch.from_arrays([*values, pa.array(removed, pa.int64())], names=[*columns, "n_removed"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return joined.select(*columns, "spans").mapInArrow(run, f"{kinds}, n_removed long")
