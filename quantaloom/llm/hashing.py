"""Vectorised text hashing for Arrow kernels.

Words are hashed straight from the UTF-8 buffer of an Arrow string array: a prefix sum of
``T[byte] * P^position`` (mod 2^64) yields every word's polynomial hash by one subtraction and one
multiplication, so there is no Python object per word.  Memory is bounded by working on groups
of documents, and on pieces of a document when it is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants drawn from a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _P + np.uint64(seed)) | np.uint64(1)


class _Powers:
    """P^j and P^-j for j < size, grown on demand."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, PIECE_BYTES)
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size - 1, _P, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size - 1, _P_INV, np.uint64)])
        return self.up, self.down


_POWERS = _Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = salts(256, 77)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def _hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``data``; no word crosses a position of ``cuts``."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~word[:-1]
    fresh[cuts] = True
    starts = np.flatnonzero(word & fresh[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:] | fresh[1:-1]
    ends = np.flatnonzero(word & last) + 1
    up, down = _POWERS.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _P), starts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls count as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def groups(batch: pa.RecordBatch, column: str, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offsets of each text's words.

    A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
    """
    data, offsets = buffers(texts)
    if len(data) <= 2 * PIECE_BYTES:
        h, starts = _hash_words(data, offsets)
        return h, np.searchsorted(starts, offsets)
    parts, counts = [], [0]
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n, at = 0, lo
        while at < hi:
            to = min(at + PIECE_BYTES, hi)
            while to < hi and not _SPACE[data[to]]:  # a piece ends where a word ends
                gap = np.flatnonzero(_SPACE[data[to : to + PIECE_BYTES]])
                to = to + int(gap[0]) if len(gap) else min(to + PIECE_BYTES, hi)
            h, _ = _hash_words(data[at:to], np.array([0, to - at]))
            parts.append(h)
            n += len(h)
            at = to
        counts.append(counts[-1] + n)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(counts)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    c = salts(width, 4099)
    n = max(0, len(words) - width + 1)
    every = np.zeros(n, np.uint64)
    for k in range(width):
        every += words[k : k + n] * c[k]
    every = mix64(every)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(every[lo : hi - width + 1]))
        elif hi > lo:
            own = words[lo:hi]
            out.append(mix64(np.array([(own * c[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
