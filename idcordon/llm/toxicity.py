"""Toxicity by class-conditional Kneser-Ney models.

One model of strings of bytes is learnt from toxic and one from ordinary labelled documents. A
model predicts each byte from the ``order`` - 1 before it and backs off, with Kneser-Ney
discounts and continuation counts, to shorter contexts; contexts shorter than ``shared`` bytes
are counted over both kinds together, so that a rare expression is not evidence merely because
one kind has less text. The difference of both log-likelihoods, summed over each word, gives a
document's evidence: its mean per word, its largest word, and the sum of what stands out. A
logistic fit on labelled documents that the models have not seen turns it into a probability.

The models learn from a sample of the labelled documents, bounded for each kind and taken by a
hash of the id. All strings of the sample are kept, so discounts and continuation counts are
those of the whole sample. Every document is scored over its whole text.

Texts are lower-cased; words are runs of letters, digits and other non-ASCII characters. Defined
results: null and empty texts and texts without words carry no evidence and get the probability
of none. Null labels, and documents with contradicting ones, are not learnt from. Without labels
of both kinds every score is 0. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idcordon.llm import words as W
from idcordon.llm.ctw import strings
from idcordon.llm.decontam import _GAPS
from idcordon.sources.shared import stored

_U = np.uint64


@dataclass(frozen=True)
class ToxicityOptions:
    """train_documents: labelled documents of each kind to learn the models from, at most. fit_documents: of
    each kind, at most, for the logistic fit.

    order: bytes of a string, at most 7. shared: contexts shorter than that are counted over both kinds.
    striking: gain from which on a word stands out. threshold: least score of the label 1.
    """

    train_documents: int = 3000
    fit_documents: int = 1000
    order: int = 6
    shared: int = 3
    striking: float = 3.0
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Differences of log-probabilities, toxic less ordinary, by length of the string."""

    codes: list[np.ndarray]  # known strings: of one byte, of two, ..
    gain: list[np.ndarray]  # of their last byte
    contexts: list[np.ndarray]
    back: list[np.ndarray]  # of backing off from a context
    fit: np.ndarray  # logistic weights of the evidence and the constant


def _low(codes: np.ndarray, size: int) -> np.ndarray:
    return codes & _U((1 << (8 * size)) - 1)


def learn(codes: np.ndarray, counts: np.ndarray, order: int, shared: int) -> ToxicityModel:
    """From strings of ``order`` bytes and their counts in ordinary and toxic text (n x 2). No fit yet."""
    by = np.argsort(codes)
    own = [(codes[by], counts[by].astype(float))]
    for size in reversed(range(1, order)):  # continuation counts: in how many longer strings, by kind
        value, index = np.unique(_low(own[-1][0], size), return_inverse=True)
        own.append((value, np.column_stack([np.bincount(index, weights=own[-1][1][:, c] > 0, minlength=len(value)) for c in (0, 1)])))
    own.reverse()
    lower: np.ndarray | None = None
    gain, contexts, back = [], [], []
    for size, (value, n) in enumerate(own, 1):
        if size <= shared:
            n = np.repeat(n.sum(axis=1)[:, None], 2, axis=1)
        context, at = np.unique(value >> _U(8), return_inverse=True)
        below = np.full((len(value), 2), 1 / 256) if size == 1 else lower[np.searchsorted(own[size - 2][0], _low(value, size - 1))]
        p, weight = np.zeros_like(below), np.zeros((len(context), 2))
        for c in (0, 1):
            one, two = (n[:, c] == 1).sum(), (n[:, c] == 2).sum()
            d = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
            total = np.bincount(at, weights=n[:, c], minlength=len(context))
            kinds = np.bincount(at, weights=n[:, c] > 0, minlength=len(context))
            weight[:, c] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            p[:, c] = np.maximum(n[:, c] - d, 0) / np.maximum(total, 1)[at] + weight[at, c] * below[:, c]
        gain.append((np.log(p[:, 1]) - np.log(p[:, 0])).astype(np.float32))
        contexts.append(context)
        back.append((np.log(weight[:, 1]) - np.log(weight[:, 0])).astype(np.float32))
        lower = p
    return ToxicityModel([v for v, _ in own], gain, contexts, back, np.zeros(FEATURES))


FEATURES = 5


class Scorer:
    def __init__(self, model: ToxicityModel, options: ToxicityOptions) -> None:
        self.model, self.options = model, options
        self.tables = [W.Table(c) for c in model.codes]
        self.contexts = [W.Table(c) for c in model.contexts]

    def byte_gain(self, code: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(code)), np.arange(len(code))
        for size in reversed(range(1, len(self.tables) + 1)):
            short = _low(code[left], size)
            got = self.tables[size - 1].find(short)
            out[left[got >= 0]] += self.model.gain[size - 1][got[got >= 0]]
            left, short = left[got < 0], short[got < 0]
            if not len(left):
                break
            known = self.contexts[size - 1].find(short >> _U(8))
            out[left] += np.where(known >= 0, self.model.back[size - 1][np.maximum(known, 0)], 0) if len(self.model.back[size - 1]) else 0
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row of ``FEATURES`` numbers for each text, the last a constant."""
        out = [self._block(b) for b in W.blocks(pc.utf8_lower(texts))]
        return np.concatenate(out) if out else np.zeros((0, FEATURES))

    def _block(self, block: W.Block) -> np.ndarray:
        out = np.zeros((block.n, FEATURES))
        out[:, -1] = 1
        words = W.split(block, _GAPS)
        if not len(words.starts):
            return out
        code, _ = strings(block, len(self.tables) - 1)
        sums = np.concatenate([[0.0], np.cumsum(self.byte_gain(code))])
        gain = sums[words.ends + words.text] - sums[words.starts + words.text]
        n = np.diff(words.first)
        some = np.flatnonzero(n > 0)
        out[:, 0] = np.bincount(words.text, weights=gain, minlength=block.n) / np.maximum(n, 1)
        out[some, 1] = np.maximum.reduceat(gain, words.first[some]) / 10
        out[:, 2] = np.log1p(np.bincount(words.text, weights=np.maximum(0, gain - self.options.striking), minlength=block.n))
        out[:, 3] = np.log1p(n) / 5
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.model.fit, -30, 30)))


def _sample(labels: DataFrame, learnt: Column, options: ToxicityOptions) -> DataFrame:
    """(of_id, toxic, fit) of at most ``train_documents`` + ``fit_documents`` labelled documents of each kind, by hash of the id."""
    agreed = labels.where(learnt).groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    agreed = agreed.where("lo = hi AND lo IN (0, 1)").select(F.col("doc_id").alias("of_id"), F.col("lo").cast("int").alias("toxic"))
    placed = agreed.withColumn("place", F.xxhash64("of_id", F.lit(6)))
    part = F.pmod("place", F.lit(options.train_documents + options.fit_documents))
    most = options.train_documents + options.fit_documents
    kinds = [placed.where(F.col("toxic") == k).orderBy("place", "of_id").limit(most) for k in (0, 1)]
    return kinds[0].unionByName(kinds[1]).select("of_id", "toxic", (part < options.fit_documents).alias("fit"))


def train(docs: DataFrame, labels: DataFrame, learnt: Column, options: ToxicityOptions | None = None) -> ToxicityModel | None:
    """``learnt``: condition over doc_id: the rows whose labels may be used. None without labels of both kinds."""
    options = options or ToxicityOptions()
    sample = stored(_sample(labels, learnt, options), "toxicity-sample")
    # A bounded number of rows goes to all tasks; the texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of_id"))
    counts = _counted(rows.where("NOT fit"), options.order).toArrow()  # of a bounded number of rows
    n = np.column_stack([counts["n0"].to_numpy(), counts["n1"].to_numpy()])
    if not len(n) or not n.sum(axis=0).all():
        return None
    model = learn(counts["code"].to_numpy().view(_U), n, options.order, options.shared)
    # Of each kind a bounded number is sampled; the weights bring their true shares back.
    shares = {r[0]: r[1] for r in labels.where(learnt).groupBy("toxic").count().collect()}
    return _fitted(rows.where("fit"), model, shares, options)


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """(code, n0, n1): strings of the sample and their counts in ordinary and toxic text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b["toxic"].to_numpy()
            for block in W.blocks(pc.utf8_lower(b["text"])):
                code, offsets = strings(block, order - 1)
                label = np.repeat(toxic[block.first : block.first + block.n], np.diff(offsets))
                value, index = np.unique(code, return_inverse=True)
                n = [np.bincount(index, weights=label == k, minlength=len(value)).astype(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["code", "n0", "n1"])

    flat = rows.select("text", "toxic").mapInArrow(run, "code long, n0 long, n1 long")
    return flat.groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fitted(rows: DataFrame, model: ToxicityModel, shares: dict[int, int], options: ToxicityOptions) -> ToxicityModel:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # strings of a bounded number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, options)
        for b in batches:
            x = scorer.evidence(b["text"])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(FEATURES)), b["toxic"]], names=names)

    names = [*(f"x{k}" for k in range(FEATURES)), "toxic"]
    kinds = ", ".join(f"x{k} double" for k in range(FEATURES))
    got = rows.select("text", "toxic").mapInArrow(run, f"{kinds}, toxic int").toArrow()  # twice fit_documents rows at most
    x = np.column_stack([got[f"x{k}"].to_numpy() for k in range(FEATURES)])
    y, fit = got["toxic"].to_numpy().astype(float), np.zeros(FEATURES)
    weight = np.where(y == 1, shares.get(1, 0) / max(1, (y == 1).sum()), shares.get(0, 0) / max(1, (y == 0).sum()))
    weight = weight * len(y) / max(1.0, weight.sum())
    ridge = np.array([1e-2] * (FEATURES - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
        fit = fit + np.clip(np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * fit), -5, 5)
    return replace(model, fit=fit)


def score(docs: DataFrame, model: ToxicityModel | None, options: ToxicityOptions | None = None) -> DataFrame:
    """doc_id, score and predicted of every row; of a score only the text is read."""
    options = options or ToxicityOptions()
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, options) if shared.value else None
        for b in batches:
            s = scorer.scores(b["text"]) if scorer else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(s), pa.array((s >= options.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
