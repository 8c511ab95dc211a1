"""Words and their hashes for Arrow batches of texts, in blocks of bounded size.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A-Z
count as a-z. Hashes are 64-bit polynomials over random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _BASE)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses modulo 2**64."""
    if len(_POWERS[0]) <= n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n + 1, base, dtype=_U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


@dataclass
class Block:
    """Whole texts laid end to end: ``data[offsets[i]:offsets[i + 1]]`` is text ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a batch in blocks of ``limit`` bytes, or of one text if that is longer. Null: empty."""
    texts = pa.array(texts) if not isinstance(texts, pa.Array) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        own = offsets[at : end + 1]
        yield Block(at, data[own[0] : own[-1]], own - own[0])
        at = end


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Sums of byte value times base power, so that any stretch's hash is a difference."""
    power, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * power[: len(data)], out=sums[1:])
    return sums


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # index of the word's text in its block
    first: np.ndarray  # index of each text's first word, and the number of words


def split(block: Block, gaps: np.ndarray = _SPACE) -> Words:
    """The words of a block; ``gaps``: by byte, whether it parts words."""
    inner = ~gaps[block.data]
    before = np.zeros(len(inner), dtype=bool)
    before[1:] = inner[:-1]
    cut = block.offsets[:-1]
    cut = cut[cut < len(inner)]
    before[cut] = False  # a text's first byte starts a word whatever the text before ends with
    after = np.zeros(len(inner), dtype=bool)
    after[:-1] = inner[1:]
    last = block.offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(inner & ~after) + 1
    first = np.searchsorted(starts, block.offsets)
    text = np.repeat(np.arange(block.n), np.diff(first))
    return Words(starts, ends, text, first)


def word_hashes(block: Block, words: Words) -> np.ndarray:
    sums = prefix_hash(block.data, fold=True)
    _, inverse = powers(len(block.data))
    return mix64((sums[words.ends] - sums[words.starts]) * inverse[words.starts] + _U(1))


def counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    parts = [np.diff(split(b).first) for b in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(m, dtype=_U)
    for k in range(n):
        total += hashes[k : k + m] * _U(pow(int(_BASE), 2 * k + 1, 1 << 64))
    return mix64(total)


class Table:
    """Values by 64-bit key, looked up for whole arrays; open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = keys.astype(_U, copy=False)
        self.size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slot = np.full(self.size, -1, dtype=np.int32)
        self.keys = keys
        left, probe = np.arange(len(keys), dtype=np.int64), 0
        while len(left):
            at = self._place(keys[left], probe)
            free = self.slot[at] < 0
            at, who = at[free], left[free]
            self.slot[at] = who
            left = np.concatenate([left[~free], who[self.slot[at] != who]])
            probe += 1
        self.probes = probe

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        spread = (keys * _U(0x9E3779B97F4A7C15)) >> _U(20)
        return ((spread + _U(probe)) & _U(self.size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the table's keys, -1 where it isn't there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys) or not len(keys):
            return out
        left = np.arange(len(keys))
        for probe in range(self.probes):
            got = self.slot[self._place(keys[left], probe)]
            there = got >= 0
            same = there & (self.keys[np.maximum(got, 0)] == keys[left])
            out[left[same]] = got[same]
            left = left[there & ~same]
            if not len(left):
                break
        return out
