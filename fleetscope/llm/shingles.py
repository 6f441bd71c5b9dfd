"""Word shingles of whole texts as sets of 64-bit hashes, by numpy over Arrow buffers.

Words are runs of bytes other than space and tab to carriage return, with A-Z lower-cased. A word's hash is a
polynomial over its bytes with prefix sums, so no word is ever a Python object; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time (the cut falls on a separator).
WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE & 0xFFFFFFFF))
    byte[65:91] = byte[97:123]
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return byte, gap


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * WINDOW)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(row))
        _POWERS[:] = out
    return _POWERS


def _word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in ``data``; ``first`` marks bytes that begin a text."""
    byte, gap = _tables()
    word = ~gap[data]
    if not word.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    before = np.r_[False, word[:-1]]
    start = np.flatnonzero(word & (~before | first))
    after_gap = np.r_[~word[1:], True]
    end = np.flatnonzero(word & (after_gap | np.r_[first[1:], True]))
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum(byte[data] * up[: len(data)])
        h = sums[end] - np.where(start > 0, sums[start - 1], np.uint64(0))
        h = h * down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return start, mix(h)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (large strings, none null) in order, and the words of each text."""
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if raw[-1] == raw[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[raw[0] : raw[-1]]
    bounds = raw - raw[0]
    _, gap = _tables()
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = lo + WINDOW
        while hi < len(data):  # up to the next separator or text begin
            more = np.flatnonzero(gap[data[hi : hi + WINDOW]])
            cut = hi + int(more[0]) if len(more) else hi + WINDOW
            b = bounds[np.searchsorted(bounds, hi)]
            if b <= cut or len(more):
                hi = min(cut, int(b))
                break
            hi = cut
        hi = min(hi, len(data))
        first = np.zeros(hi - lo, bool)
        here = bounds[(bounds >= lo) & (bounds < hi)] - lo
        first[here] = True
        s, h = _word_hashes(data[lo:hi], first)
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    start, all_hashes = np.concatenate(starts), np.concatenate(hashes)
    return all_hashes, np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than ``words`` are one shingle, none give none."""
    hashes, count = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    joined = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            joined = (joined ^ hashes[k : k + n]) * np.uint64(0x100000001B3 + 2 * k) + (joined >> np.uint64(29))
    joined = mix(joined)
    at = 0
    for c in count.tolist():
        if c >= words:
            yield np.unique(joined[at : at + c - words + 1])
        elif c:
            one = np.uint64(c)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + c]:
                    one = (one ^ h) * np.uint64(0x9FB21C651E98DF25) + (one >> np.uint64(31))
            yield mix(np.array([one], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += c


def batches_of_sets(batch: pa.RecordBatch, words: int, chars: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch whose second column is the text; a bounded number of bytes is hashed at a time."""
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(texts):
        hi, used = lo + 1, int(size[lo])
        while hi < len(texts) and used + size[hi] <= chars:
            used += int(size[hi])
            hi += 1
        for i, s in enumerate(shingle_sets(texts.slice(lo, hi - lo), words)):
            yield lo + i, s
        lo = hi
