"""Quality classifier by co-training.

Two logistic models see different views of a document: its text (shares of kinds of characters,
repeated words and lines, lengths) and its page metadata (source, language, stated length).
Both are first fitted to the labelled documents. Then, in each round, every unlabelled document
of which one view is confident is given to the other view as a pseudo-label, and both are fitted
again. At the end the views are calibrated together on labelled documents kept out of all fits,
and every document gets a score between 0 and 1.

Fits are Newton steps. Their sums run over all rows in Spark; only matrices as wide as a view
come to the driver, so all labels and all unlabelled documents count, at any size.

Defined results: a null or empty text has features of 0 and is scored like any other, so are
null metadata. A document with contradicting labels counts as unlabelled. Without labels of
both kinds every score is 0.5 and every document is kept. Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.llm import words as W
from idcordon.sources.shared import stored


@dataclass(frozen=True)
class QualityOptions:
    """confident: probability from which on a view teaches the other. pseudo_weight: of such a row.

    calibration: one in so many labelled documents, by hash of the id, is kept out of the fits.
    """

    rounds: int = 2
    confident: float = 0.97
    pseudo_weight: float = 0.3
    steps: int = 5
    ridge: float = 1.0
    calibration: int = 5
    threshold: float = 0.5
    source_buckets: int = 32
    lang_buckets: int = 8


# ---------------------------------------------------------------- views

# Kinds of bytes: the index of each in a histogram.
_KINDS = np.zeros(256, dtype=np.int64)
for _k, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\t\n\v\f\r", b".,;:'\"?-()", b"!", b"|"]):
    _KINDS[list(_set)] = _k + 1
_KINDS[128:] = 9
_N_KINDS = 10
TEXT_WIDTH = _N_KINDS + 12


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of numbers of order 1 for each text."""
    parts = [_block_features(b) for b in W.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, TEXT_WIDTH))


def _per_text(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights=weights, minlength=n)[:n].astype(float)


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each text."""
    keyed = np.unique(W.mix64(value ^ W.mix64(text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return _per_text(text[keyed], n)


def _block_features(block: W.Block) -> np.ndarray:
    n = block.n
    size = np.diff(block.offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * _N_KINDS + _KINDS[block.data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    words = W.split(block)
    value = W.word_hashes(block, words)
    count = np.diff(words.first).astype(float)
    safe, safe_bytes = np.maximum(count, 1), np.maximum(size, 1)
    length = words.ends - words.starts
    same = np.zeros(len(value), dtype=bool)
    same[1:] = (value[1:] == value[:-1]) & (words.text[1:] == words.text[:-1])
    ends = block.data[words.ends - 1] if len(words.ends) else np.zeros(0, dtype=np.uint8)
    odd = (_KINDS[ends] == 0) | (_KINDS[ends] == 6) | (_KINDS[ends] == 7)
    pairs = W.gram_hashes(value, 2)
    inside = words.text[1:] == words.text[:-1]
    lines = _lines(block)
    n_lines = np.maximum(_per_text(lines[0], n), 1)
    out = np.column_stack([
        *(3 * np.sqrt(kinds / safe_bytes[:, None])).T,
        np.log1p(count) / 5,
        np.log1p(_distinct(words.text, value, n)) / 5,
        np.log1p(_distinct(words.text[:-1][inside], pairs[inside], n)) / 5 if len(value) > 1 else np.zeros(n),
        3 * _per_text(words.text, n, same) / safe,
        _distinct(words.text, value, n) / safe,
        _per_text(words.text, n, length) / safe / 5,
        np.sqrt(_per_text(words.text, n, length.astype(float) ** 2) / safe) / 5,
        3 * _per_text(words.text, n, length <= 3) / safe,
        3 * _per_text(words.text, n, length > 20) / safe,
        3 * _per_text(words.text, n, odd) / safe,
        _distinct(*lines, n) / n_lines,
        np.log1p(count / n_lines) / 5,
    ])
    out[size == 0] = 0
    return out


def _lines(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the lines of a block."""
    sums = W.prefix_hash(block.data, fold=False)
    _, inverse = W.powers(len(block.data))
    cuts = np.union1d(np.flatnonzero(block.data == 10) + 1, block.offsets)
    a, b = cuts[:-1], cuts[1:]
    text = np.searchsorted(block.offsets, a, side="right") - 1
    return text, W.mix64((sums[b] - sums[a]) * inverse[a])


def meta_features(source: list, lang: list, n_chars: list, options: QualityOptions) -> np.ndarray:
    """Length, and one place for each bucket of sources and languages."""
    out = np.zeros((len(source), 2 + options.source_buckets + options.lang_buckets))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        size = np.log1p(max(0, n or 0)) / 5
        out[i, :2] = size, size * size / 2
        out[i, 2 + zlib.crc32(repr(s).encode()) % options.source_buckets] = 1
        out[i, 2 + options.source_buckets + zlib.crc32(repr(g).encode()) % options.lang_buckets] = 1
    return out


def _features(b: pa.RecordBatch, options: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones((len(b), 1))
    meta = meta_features(b["source"].to_pylist(), b["lang"].to_pylist(), b["n_chars"].to_pylist(), options)
    return np.hstack([text_features(b["text"]), one]), np.hstack([meta, one])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---------------------------------------------------------------- model


@dataclass
class QualityModel:
    """Weights of both views, and of their joint calibration (text, meta, constant)."""

    options: QualityOptions
    text: np.ndarray
    meta: np.ndarray
    joint: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.clip(text @ self.text, -12, 12), np.clip(meta @ self.meta, -12, 12)

    def scores(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by text, by metadata, by both."""
        t, m = self.views(*_features(b, self.options))
        return _sigmoid(t), _sigmoid(m), _sigmoid(t * self.joint[0] + m * self.joint[1] + self.joint[2])


def _training_rows(docs: DataFrame, labels: DataFrame, options: QualityOptions) -> DataFrame:
    """(text_view, meta_view, label, kept_out): features of every document as bytes, and its label if it has one."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    agreed = agreed.where("lo = hi").select(F.col("doc_id").alias("of_id"), F.col("lo").cast("int").alias("label"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = (x.astype(np.float32) for x in _features(b, options))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())],
                names=["doc_id", "text_view", "meta_view"],
            )

    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, f"doc_id {kind}, text_view binary, meta_view binary")
    joined = rows.join(agreed, F.col("doc_id") == F.col("of_id"), "left")
    out = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(options.calibration)) == 0
    return joined.select("text_view", "meta_view", F.coalesce("label", F.lit(-1)).alias("label"), (out & F.col("label").isNotNull()).alias("kept_out"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = pa.array(column, pa.binary()) if not isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=np.float32).reshape(-1, width).astype(float)


def _sums(rows: DataFrame, model: QualityModel, what: str, pseudo: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Newton sums (matrix, vector) over all rows: of both views, or of the calibration."""
    widths = (len(model.text), len(model.meta))
    o = model.options

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def add(view: int, x: np.ndarray, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
            hess = x.T @ (x * (w * p * (1 - p))[:, None])
            flat = np.concatenate([hess.ravel(), x.T @ (w * (y - p)), [(w * (y == 1)).sum(), (w * (y == 0)).sum()]])
            total[view] = total.get(view, 0) + flat

        for b in batches:
            text, meta = _matrix(b["text_view"], widths[0]), _matrix(b["meta_view"], widths[1])
            label, out = b["label"].to_numpy(), b["kept_out"].to_numpy(zero_copy_only=False)
            t, m = model.views(text, meta)
            if what == "joint":
                x = np.column_stack([t, m, np.ones(len(t))])
                add(0, x, _sigmoid(x @ model.joint), np.maximum(label, 0).astype(float), out.astype(float))
                continue
            known = (label >= 0) & ~out
            for view, (x, own, other) in enumerate(((text, t, m), (meta, m, t))):
                taught = _sigmoid(other)
                sure = (label < 0) & ((taught >= o.confident) | (taught <= 1 - o.confident)) & pseudo
                y = np.where(known, label, taught >= 0.5).astype(float)
                add(view, x, _sigmoid(own), y, known + o.pseudo_weight * sure)
        for view, flat in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), view, dtype=np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                names=["view", "place", "value"],
            )

    got = rows.mapInArrow(partial, "view int, place int, value double").groupBy("view", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for view, (name, d) in enumerate([("joint", 3)] if what == "joint" else [("text", widths[0]), ("meta", widths[1])]):
        flat = np.zeros(d * d + d + 2)
        for r in got:
            if r["view"] == view:
                flat[r["place"]] = r["value"]
        if flat[-1] > 0 and flat[-2] > 0:
            out[name] = flat[: d * d].reshape(d, d), flat[d * d : -2]
    return out


def _newton(weights: np.ndarray, sums: tuple[np.ndarray, np.ndarray], ridge: float) -> np.ndarray:
    hess, grad = sums
    penalty = np.full(len(weights), ridge)
    penalty[-1] = 1e-3
    step = np.linalg.solve(hess + np.diag(penalty), grad - penalty * weights)
    return weights + np.clip(step, -4, 4)


def train(docs: DataFrame, labels: DataFrame, options: QualityOptions | None = None) -> QualityModel:
    options = options or QualityOptions()
    rows = stored(_training_rows(docs, labels, options), "quality-rows")
    model = QualityModel(options, np.zeros(TEXT_WIDTH + 1), np.zeros(3 + options.source_buckets + options.lang_buckets))
    for turn in range(options.rounds + 1):
        for _ in range(options.steps if turn == 0 else 2):
            sums = _sums(rows, model, "views", pseudo=turn > 0)
            if not sums:
                model.joint[:] = 0
                return model
            text = _newton(model.text, sums["text"], options.ridge)
            model = QualityModel(options, text, _newton(model.meta, sums["meta"], options.ridge))
    for _ in range(options.steps):
        sums = _sums(rows, model, "joint", pseudo=False)
        if not sums:
            break
        model.joint = _newton(model.joint, sums["joint"], 0.1)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m, s = model.scores(b)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(t), pa.array(m), pa.array(s), pa.array(s >= model.options.threshold)],
                names=["doc_id", "text_score", "meta_score", "score", "keep"],
            )

    columns = docs.select("doc_id", "text", "source", "lang", "n_chars")
    return columns.mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that the model keeps, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b)[2] >= model.options.threshold))

    return docs.mapInArrow(run, docs.schema)
