"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. For each decision (the bits of the byte seen so far) there is
a tree of contexts, the bytes before it, newest first. Every node keeps how often a 0 and a 1
followed it in the training texts and predicts by the Krichevsky-Trofimov estimator. A node's
weighted probability is half its own estimate's plus half the product of its children's; the
share of its own is how much the node trusts itself against all deeper contexts. The prediction
of a bit mixes the nodes of all depths on its path with these shares, the deepest known node
taking what is left. A text ends with a byte that UTF-8 never uses, so the probabilities of all
texts add up to at most one.

Counts run over all training texts in Spark: each task counts its own strings of ``depth`` + 1
bytes, and the sums are taken by string. No string is left out of the tree. It is cut into parts by the
newest two context bytes. Tasks weigh the subtrees of their parts from the leaves up; the sums of
these weights by node of one context byte, and the counts of the shorter contexts, are bounded by the
alphabet and make up the top, which all tasks get. Strings are then scored part by part, below that top.
The most frequent ones are scored first and sent to the tasks that read the texts; the others are joined.

Beside the model stands the word-unigram score that it is compared with.

Defined results: a null text is empty; its score is the probability of ending at once. Rows with
a null id are learnt from. Repeated rows are learnt from once each and scored alike. An empty
table gives no rows; without training rows every bit has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idcordon.llm import words as W
from idcordon.sources.shared import stored

_U = np.uint64
END = 0xFF
_END_WORD = W.mix64(np.array([0xE0D], dtype=_U))[0]


@dataclass(frozen=True)
class ScoreOptions:
    """depth: bytes of the longest context, 1 to 6. nodes, common_words: so many of the most frequent strings and words
    at most are sent to all tasks; the others are joined, so neither changes a result.
    """

    depth: int = 5
    nodes: int = 3 << 18
    common_words: int = 1 << 19


# ---------------------------------------------------------------- strings of bytes


def strings(block: W.Block, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, offsets): for each byte of each text and its end, the ``depth`` bytes before it and itself.

    The newest context byte is the lowest above the byte; before a text's start contexts are 0.
    """
    offsets = block.offsets + np.arange(block.n + 1)
    data = np.full(offsets[-1], END, dtype=np.uint8)
    inner = np.ones(len(data), dtype=bool)
    inner[offsets[1:] - 1] = False
    data[inner] = block.data
    code = data.astype(_U)
    for j in range(1, depth + 1):
        back = np.zeros(len(data), dtype=_U)
        back[j:] = data[:-j] if j < len(data) else back[j:]
        for t in range(j):  # the first places of a text look back into the text before it
            at = offsets[:-1] + t
            back[at[at < offsets[1:]]] = 0
        code |= back << _U(8 * j)
    return code, offsets


class Counter:
    """Counts of 64-bit values, kept until there are ``limit`` different ones."""

    def __init__(self, limit: int = 1 << 21) -> None:
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts the values; gives off all counts when there are too many."""
        part = np.unique(values, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size < 2 * self.limit:
            return None
        self._merge()
        return self.take() if self.size >= self.limit else None

    def _merge(self) -> None:
        value, index = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(index, weights=np.concatenate([p[1] for p in self.parts]), minlength=len(value)).astype(np.int64)
        self.parts, self.size = [(value, n)], len(value)

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        self._merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def _counted(texts: DataFrame, name: str, values: Callable[[W.Block], np.ndarray]) -> DataFrame:
    """(name, n): how often each value occurs in the blocks of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for block in W.blocks(b["text"]):
                if full := counter.add(values(block)):
                    yield batch(full)
        if rest := counter.take():
            yield batch(rest)

    def batch(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts[0].view(np.int64)), pa.array(counts[1])], names=[name, "n"])

    return texts.select("text").mapInArrow(run, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def _string_counts(texts: DataFrame, depth: int) -> DataFrame:
    return _counted(texts, "code", lambda block: strings(block, depth)[0])


def _common(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent strings, ``most`` of them at most: by power-of-two step of their count, no step in part."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    sizes = {r[0]: r[1] for r in counts.groupBy(step).count().collect()}  # a few hundred rows
    total, bound = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        bound = s
    return counts.where(step >= bound) if bound is not None else counts.where("false")


# ---------------------------------------------------------------- tree


@dataclass(frozen=True)
class Level:
    """Strings of one context length, with the log10 probability of their byte, and their binary nodes."""

    codes: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    keys: list[np.ndarray]  # by number of bits seen: context and bits
    ones: list[np.ndarray]  # probability of a 1, with this node the deepest


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2), by Stirling's series from an argument of at least 8."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    n = zeros + ones
    factorial = _lgamma_half(n + 0.5)
    return _lgamma_half(zeros) + _lgamma_half(ones) - np.log(np.pi) - factorial


def _nodes(codes: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones, node of each string) of the decisions after ``bits`` bits."""
    key = codes >> _U(8 - bits)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    bit = (codes >> _U(7 - bits)) & _U(1)
    if not len(head):
        return key, n, n, head
    one = np.add.reduceat(n * (bit == 1), head)
    every = np.add.reduceat(n, head)
    return key[head], every - one, one, np.repeat(np.arange(len(head)), np.diff(head, append=len(key)))


def _above(key: np.ndarray, d: int, bits: int) -> np.ndarray:
    """Nodes of context length ``d`` to their parents, which lack the oldest byte."""
    return (((key >> _U(bits)) & _U((1 << (8 * (d - 1))) - 1)) << _U(bits)) | (key & _U((1 << bits) - 1))


def _weighed(
    nodes: list, parents: list[np.ndarray], bits: int, root: int = 0, given: tuple[int, np.ndarray] | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weighted log probabilities of the nodes of context length ``root``, and each node's own share by length.

    ``given``: a length, and for its nodes the sums over their children, of which not all are here.
    """
    depth = len(nodes) - 1
    shares: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    weighted = np.zeros(0)
    for d in reversed(range(root, depth + 1)):
        _, zero, one, _ = nodes[d][bits]
        own = kt(zero, one)
        if d == depth:
            weighted, share = own, np.ones(len(own))
        else:
            at, (_, z, o, _) = parents[d + 1], nodes[d + 1][bits]
            size = len(own)
            if given is not None and d == given[0]:
                children = given[1]
            else:
                rest_zero = np.maximum(0, zero - np.bincount(at, weights=z, minlength=size))
                rest_one = np.maximum(0, one - np.bincount(at, weights=o, minlength=size))
                children = np.bincount(at, weights=weighted, minlength=size) + kt(rest_zero, rest_one)
            weighted = np.logaddexp(own, children) - np.log(2)
            share = np.exp(own - np.log(2) - weighted)
        shares[d] = share
    return weighted, shares


def _parents(nodes: list, bits: int, root: int = 0) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * (root + 1)
    return out + [
        np.searchsorted(nodes[d - 1][bits][0], _above(nodes[d][bits][0], d, bits)) for d in range(root + 1, len(nodes))
    ]


def build_tree(
    levels: list[tuple[np.ndarray, np.ndarray]], given: tuple[int, list[np.ndarray]] | None = None
) -> list[Level]:
    """The tree of the strings (codes, counts) of each context length.

    ``given``: a context length up to which the strings are those of all texts, while longer ones may be those of some
    contexts only, and by number of bits, for each node of that length, the sum of all its children's weights.
    """
    depth = len(levels) - 1
    nodes = [[_nodes(codes, n, bits) for bits in range(8)] for codes, n in levels]
    ones = [[np.zeros(0)] * 8 for _ in levels]
    for bits in range(8):
        parents = _parents(nodes, bits)
        _, own_share = _weighed(nodes, parents, bits, 0, given and (given[0], given[1][bits]))
        before, rest = np.zeros(len(nodes[0][bits][0])), np.ones(len(nodes[0][bits][0]))
        for d in range(depth + 1):
            _, zero, one, _ = nodes[d][bits]
            guess = (one + 0.5) / (zero + one + 1)
            if d:
                at = parents[d]
                before, rest = last_before[at] + last_rest[at] * last_share[at] * last_guess[at], last_rest[at] * (1 - last_share[at])
            ones[d][bits] = before + rest * guess
            last_before, last_rest, last_share, last_guess = before, rest, own_share[d], guess
    out = []
    for d, (codes, _) in enumerate(levels):
        logp = np.zeros(len(codes))
        for bits in range(8):
            bit = (codes >> _U(7 - bits)) & _U(1)
            p = ones[d][bits][nodes[d][bits][3]] if len(codes) else np.zeros(0)
            logp += np.log10(np.where(bit == 1, p, 1 - p))
        out.append(Level(codes, logp.astype(np.float32), nodes[d][0][0], [k[0] for k in nodes[d]], [x.astype(np.float32) for x in ones[d]]))
    return out


class Scorer:
    """log10 probabilities of bytes in context."""

    def __init__(self, tree: list[Level]) -> None:
        self.tree, self.depth = tree, len(tree) - 1
        self.tables = [W.Table(level.codes) for level in tree]
        self.contexts = [W.Table(level.contexts) for level in tree]

    def bytes_logp(self, code: np.ndarray) -> np.ndarray:
        """Of each string of ``depth`` + 1 bytes, the probability of the last given the others."""
        out = np.zeros(len(code))
        left, new = np.arange(len(code)), []
        for d in reversed(range(self.depth + 1)):
            short = code[left] & _U((1 << (8 * (d + 1))) - 1)
            got = self.tables[d].find(short)
            out[left[got >= 0]] = self.tree[d].logp[got[got >= 0]]
            left, short = left[got < 0], short[got < 0]
            known = self.contexts[d].find(short >> _U(8)) >= 0 if d else np.ones(len(left), dtype=bool)
            new.append((left[known], d))  # a byte that its deepest known context has not seen
            left = left[~known]
            if not len(left):
                break
        for at, d in new:
            if len(at):
                value, index = np.unique(code[at] & _U((1 << (8 * (d + 1))) - 1), return_inverse=True)
                out[at] = self._bitwise(value, d)[index]
        return out

    def _bitwise(self, code: np.ndarray, depth: int) -> np.ndarray:
        """Bit by bit: each by the deepest node of its path."""
        deepest, out = np.full(len(code), depth), np.zeros(len(code))
        for bits in range(8):
            p = np.full(len(code), 0.5)
            for d in reversed(range(depth + 1)):
                at = np.flatnonzero(deepest == d)
                if not len(at):
                    continue
                keys = self.tree[d].keys[bits]
                key = (code[at] & _U((1 << (8 * (d + 1))) - 1)) >> _U(8 - bits)
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                there = keys[place] == key if len(keys) else np.zeros(len(at), dtype=bool)
                p[at[there]] = self.tree[d].ones[bits][place[there]]
                deepest[at[~there]] = d - 1
            bit = (code >> _U(7 - bits)) & _U(1)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def texts_logp(self, block: W.Block) -> np.ndarray:
        code, offsets = strings(block, self.depth)
        return np.add.reduceat(self.bytes_logp(code), offsets[:-1]) if block.n else np.zeros(0)


# ---------------------------------------------------------------- parts of the tree

_PART_STRINGS = 1 << 17  # so many strings are taken up at once, or those of one part if they are more


def _root(depth: int) -> int:
    """Length of the contexts by which the tree is cut."""
    return min(2, depth)


def _parted(strings: DataFrame, depth: int) -> DataFrame:
    """Strings with those of their part in one task, one part after the other."""
    part = F.shiftright("code", 8).bitwiseAND((1 << (8 * _root(depth))) - 1)
    return strings.repartition(part).sortWithinPartitions(part)


def _parts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of whole parts."""
    held, size, enough = [], 0, _PART_STRINGS
    for b in batches:
        held.append((b["code"].to_numpy().view(_U), b["n"].to_numpy()))
        size += b.num_rows
        if size >= enough:
            code, n = (np.concatenate(x) for x in zip(*held))
            part = (code >> _U(8)) & _U((1 << (8 * _root(depth))) - 1)
            last = int(np.flatnonzero(part != part[-1])[-1]) + 1 if part[0] != part[-1] else 0
            if last:
                yield code[:last], n[:last]
            held, size = [(code[last:], n[last:])], len(code) - last
            enough = max(_PART_STRINGS, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _shorter(code: np.ndarray, n: np.ndarray, depth: int, root: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of all context lengths from ``root`` to ``depth``; none below."""
    levels = []
    for d in reversed(range(root, depth + 1)):
        value, index = np.unique(code & _U((1 << (8 * (d + 1))) - 1), return_inverse=True)
        code, n = value, np.bincount(index, weights=n, minlength=len(value))
        levels.append((code, n))
    none = (np.zeros(0, dtype=_U), np.zeros(0))
    return [none] * root + levels[::-1]


def _top(strings: DataFrame, depth: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[int, list[np.ndarray]]]:
    """(codes, counts) of the contexts shorter than those of the parts, and the sums of weights below the longest of them."""
    root = _root(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _parts(batches, depth):
            levels = _shorter(code, n, depth, root)
            for bits in range(8):
                nodes = [[None] * bits + [_nodes(c, m, bits)] for c, m in levels]
                weighted, _ = _weighed(nodes, _parents(nodes, bits, root), bits, root)
                node, index = np.unique(_above(nodes[root][bits][0], root, bits), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), bits, dtype=np.int32)), pa.array(node.view(np.int64)), pa.array(np.bincount(index, weights=weighted, minlength=len(node)))],
                    names=["bits", "node", "weight"],
                )

    levels = []
    for d in range(root):
        code = F.col("code").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("code")
        got = strings.groupBy(code).agg(F.sum("n").alias("n")).toArrow()  # 256 or 65,536 rows at most
        code, n = got["code"].to_numpy().view(_U), got["n"].to_numpy().astype(float)
        order = np.argsort(code)
        levels.append((code[order], n[order]))
    # Decimals add up to the same sum in any order. 65,280 rows at most.
    weight = F.sum(F.col("weight").cast("decimal(30,9)")).cast("double").alias("weight")
    sums = _parted(strings, depth).mapInArrow(run, "bits int, node long, weight double").groupBy("bits", "node").agg(weight).toArrow()
    of, node, weight = sums["bits"].to_numpy(), sums["node"].to_numpy().view(_U), sums["weight"].to_numpy()
    below = []
    for bits in range(8):
        own = np.flatnonzero(of == bits)
        below.append(weight[own[np.argsort(node[own])]])  # in the order of the nodes, each of which has children
    return levels, (root - 1, below)


def _string_scores(strings: DataFrame, asked: DataFrame, top, depth: int) -> DataFrame:
    """(code, logp): of each asked string of ``depth`` + 1 bytes the log10 probability of its last byte. Each is asked once."""
    root, shared = _root(depth), strings.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, given = shared.value
        for code, n in _parts(batches, depth):
            known, want = n > 0, code[n == 0]
            if len(want):
                below = _shorter(code[known], n[known], depth, root)[root:]
                logp = Scorer(build_tree([*levels, *below], given)).bytes_logp(want)
                yield pa.RecordBatch.from_arrays([pa.array(want.view(np.int64)), pa.array(logp)], names=["code", "logp"])

    both = strings.select("code", "n").unionByName(asked.select("code", F.lit(0).cast("long").alias("n")))
    return _parted(both, depth).mapInArrow(run, "code long, logp double")


# ---------------------------------------------------------------- words


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all training texts; each text ends with one end."""
    return _counted(
        texts, "word", lambda block: np.concatenate([W.word_hashes(block, W.split(block)), np.full(block.n, _END_WORD)])
    )


def score(docs: DataFrame, held_out: Column, options: ScoreOptions | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    ``held_out``: condition over doc_id of the rows that nothing is learnt from.
    """
    options = options or ScoreOptions()
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where("NOT held_out")

    strings_ = stored(_string_counts(training, options.depth), "strings")
    top = _top(strings_, options.depth)
    frequent = _string_scores(strings_, _common(strings_, options.nodes), top, options.depth).toArrow()  # nodes rows at most
    words = stored(_word_counts(training), "words")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    common = words.orderBy(F.desc("n"), "word").limit(options.common_words).toArrow()
    shared = spark.sparkContext.broadcast(  # all bounded
        (frequent["code"].to_numpy().view(_U), frequent["logp"].to_numpy(), common["word"].to_numpy().view(_U), common["n"].to_numpy())
    )
    floor = total + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of each text with what is known here, and one for each of its other words and strings."""
        codes, codes_logp, words_, counts = shared.value
        known_codes, table = W.Table(codes), W.Table(words_)
        counts_log = np.log10((counts + 0.5) / floor)
        for b in batches:
            h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
            for block in W.blocks(b["text"]):
                words = W.split(block)
                value = np.concatenate([W.word_hashes(block, words), np.full(block.n, _END_WORD)])
                owner = np.concatenate([words.text, np.arange(block.n)])
                at = table.find(value)
                known = at >= 0
                base = np.bincount(owner[known], weights=counts_log[at[known]], minlength=block.n)
                n_known = np.bincount(owner[known], minlength=block.n)
                n_tokens = np.bincount(owner, minlength=block.n)
                code, offsets = strings(block, options.depth)
                found = known_codes.find(code)
                byte_logp = np.zeros(len(code))
                byte_logp[found >= 0] = codes_logp[found[found >= 0]]
                logp = np.add.reduceat(byte_logp, offsets[:-1]) if block.n else np.zeros(0)
                of = block.first + np.arange(block.n)
                none = np.full(block.n, None)
                yield batch(h1[of], h2[of], none, none, n_tokens, n_known, base, logp, np.diff(block.offsets))
                who, what, times = others(owner, value, ~known)
                if len(who):
                    zero = np.zeros(len(who), dtype=np.int64)
                    yield batch(h1[block.first + who], h2[block.first + who], what, np.full(len(who), None), times, zero, zero.astype(float), zero.astype(float), zero)
                who, what, times = others(np.repeat(np.arange(block.n), np.diff(offsets)), code, found < 0)
                if len(who):
                    zero = np.zeros(len(who), dtype=np.int64)
                    yield batch(h1[block.first + who], h2[block.first + who], np.full(len(who), None), what, times, zero, zero.astype(float), zero.astype(float), zero)

    def others(owner: np.ndarray, value: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, value, times) of the rare values of each text."""
        pairs, times = np.unique(np.column_stack([owner[rare].astype(_U), value[rare]]), axis=0, return_counts=True)
        return pairs[:, 0].astype(np.int64), pairs[:, 1].view(np.int64), times

    def batch(h1, h2, word, code, n_tokens, n_known, base, logp, n_bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(h1), pa.array(h2), pa.array(word, pa.int64()), pa.array(code, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
             pa.array(base, pa.float64()), pa.array(logp, pa.float64()), pa.array(n_bytes, pa.int64())],
            names=names,
        )

    names = ["h1", "h2", "word", "code", "n_tokens", "n_known", "base", "logp", "n_bytes"]
    keyed = rows.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(F.lit(7), text))
    parts = stored(
        keyed.select("h1", "h2", "text").mapInArrow(
            run, "h1 long, h2 long, word long, code long, n_tokens long, n_known long, base double, logp double, n_bytes long"
        ).dropDuplicates(["h1", "h2", "word", "code"]),
        "scores",
    )
    # Words that are not sent to all tasks: their counts are joined, in columns as wide as a count.
    rare = parts.where("word IS NOT NULL").select("h1", "h2", F.col("word").alias("rare"), F.col("n_tokens").alias("times"))
    rare = rare.join(words, rare["rare"] == words["word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("h1", "h2").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(floor))).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    # Strings that are not sent: scored once each, then joined.
    other = parts.where("code IS NOT NULL").select("h1", "h2", F.col("code").alias("other"), F.col("n_tokens").alias("times"))
    scored = _string_scores(strings_, other.select(F.col("other").alias("code")).distinct(), top, options.depth).toDF("code", "code_logp")
    other = other.join(scored, other["other"] == scored["code"]).groupBy("h1", "h2").agg(F.sum(F.col("times") * F.col("code_logp")).alias("rare_logp"))
    texts = stored(
        parts.where("word IS NULL AND code IS NULL").drop("word", "code").join(rare, ["h1", "h2"], "left").join(other, ["h1", "h2"], "left").select(
            F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("logp") + F.coalesce("rare_logp", F.lit(0.0))).alias("score"), "n_bytes",
        ),
        "texts",
    )
    ids = keyed.select("doc_id", "held_out", "h1", "h2")
    return ids.join(texts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
