"""Words of many texts at once: cut at byte classes in numpy, coded as numbers by an Arrow dictionary.

Texts are cut at ASCII bytes only, so the words of UTF-8 texts are UTF-8. A-Z are lower-cased and no other letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Texts in a shard, which bounds the shards of empty texts.
SHARD_TEXTS = 50_000

SPACES = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    data: np.ndarray  # bytes of all words, one after the other
    length: np.ndarray
    text: np.ndarray  # the text of each word
    broken: np.ndarray  # whether a break or the begin of a text lies before the word


def split(texts: pa.Array, spaces: bytes = SPACES, breaks: bytes = BREAKS) -> Words:
    """The words of ``texts`` (large strings, none null): runs of bytes that are neither ``spaces`` nor ``breaks``."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = np.zeros(256, np.uint8)
    kind[np.frombuffer(spaces, np.uint8)] = 1
    kind[np.frombuffer(breaks, np.uint8)] = 2
    kind = kind[raw]
    word = kind == 0
    before = np.r_[False, word[:-1]] if len(raw) else word
    after = np.r_[word[1:], False] if len(raw) else word
    cut = at[(at > 0) & (at < len(raw))]
    before[cut] = False
    after[cut - 1] = False
    begin = np.flatnonzero(word & ~before)
    length = np.flatnonzero(word & ~after) + 1 - begin
    text = np.searchsorted(at, begin, "right") - 1
    passed = np.searchsorted(np.flatnonzero(kind == 2), begin)
    broken = np.ones(len(begin), bool)
    broken[1:] = (passed[1:] != passed[:-1]) | (text[1:] != text[:-1])
    return Words(_LOWER[raw[word]], length, text, broken)


def coded(words: Words) -> tuple[np.ndarray, list[str]]:
    """The number of each word in the list of distinct words, and that list."""
    offsets = np.zeros(len(words.length) + 1, np.int64)
    np.cumsum(words.length, out=offsets[1:])
    some = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.length), [None, pa.py_buffer(offsets), pa.py_buffer(words.data)])
    found = some.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.cast(pa.large_string()).to_pylist()


def slices(texts: pa.Array, most: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of ``texts`` with ``most`` bytes, or a single text that is longer."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        used = int(size[lo - 1]) if lo else 0
        hi = int(np.searchsorted(size, used + most, "right"))
        hi = min(max(hi, lo + 1), lo + SHARD_TEXTS, len(texts))
        yield lo, hi
        lo = hi


def plain(column: pa.Array) -> pa.Array:
    """A text column as large strings, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def packed(values: np.ndarray) -> bytes:
    """32-bit or 64-bit integers, compressed by planes of bytes (the high ones are alike)."""
    values = np.ascontiguousarray(values)
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpacked(raw: bytes, n: int, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(np.frombuffer(pa.decompress(raw, size * n, "zstd", asbytes=True), np.uint8).reshape(size, n).T.tobytes(), kind)


def shard_number(partition: int, nth: int) -> int:
    """A number of its own for each shard of a table."""
    if nth >= 1 << 11 or partition >= 1 << 22:
        raise ValueError("more shards than can be numbered: read the table in more or fewer partitions")
    return partition << 11 | nth


#: Bits of a number within a shard: a text has fewer bytes.
SHARD_BITS = 30
