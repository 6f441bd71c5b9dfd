"""Token ids by the ``tokenizers`` library, with a per-worker cache of space-free chunks.

The word-level vocabulary drops white space and never joins across it, so the ids of a text are the ids of its
chunks between spaces and line feeds, one after the other. Each chunk that the cache lacks is encoded by the
library; the rest of the work is a dictionary encoding and a gather in Arrow and numpy.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word, the marks after it, and the end of the chunk. The vocabulary cuts words from marks anyway (an apostrophe may
#: belong to either, so it is not among the marks), and lower-cases everything: both leave fewer chunks to encode.
_WORD_END = r"(\pL)([.,;:!?#$%&*]+)([ \n])"

#: Its id comes from this character alone.
_MARK = "\x01"

#: Chunks in each of the two generations that a Python worker keeps (about 200 bytes a chunk).
CACHED_CHUNKS = 250_000
#: Characters encoded at a time.
SLICE_CHARS = 4_000_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.largest_id = max(self.library.get_vocab(with_added_tokens=True).values())
        self.mark = self.library.encode(_MARK, add_special_tokens=False).ids[0]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk, by one call of the library for many chunks with a control character between them."""
        odd = [c for c in chunks if _MARK in c or "<|" in c]
        out = {c: np.asarray(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in odd}
        plain = [c for c in chunks if c not in out] if odd else chunks
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            ids = np.asarray(self.library.encode_batch_fast([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark) * 4
            raw = ids.tobytes()
            for c, a, b in zip(some, [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True):
                out[c] = raw[a:b]
        return out

    def _found(self, words: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_CHUNKS:  # what was not used since the last time is forgotten
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        lacking = [w for w, v in zip(words, found, strict=True) if v is None]
        if lacking:
            new = {w: old[w] for w in lacking if w in old}
            new.update(self._chunks([w for w in lacking if w not in new]))
            young.update((w, v) for w, v in new.items() if len(w) < 64)
            found = [new[w] if v is None else v for w, v in zip(words, found, strict=True)]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) in a row as uint32, and the number of ids of each text."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # might begin the name of a special token
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _WORD_END, r"\1 \2\3")
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        found = self._found(words)
        flat = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(length) - length
        n = length[at]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(first[at] - before, n) + np.arange(int(n.sum()), dtype=np.int64)]
        bounds = np.r_[0, np.cumsum(per_text)]
        upto = np.r_[0, np.cumsum(n)][bounds]
        return ids, np.diff(upto)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, path: str, end_id: int | None) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids) for each row of a batch (id, text); null text is empty; ``end_id`` ends each document."""
    enc = encoder(path)
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ids = batch.column(0).to_pylist()
    lo = 0
    while lo < len(ids):
        hi, used = lo + 1, int(size[lo])
        while hi < len(ids) and used + size[hi] <= SLICE_CHARS:
            used += int(size[hi])
            hi += 1
        flat, n = enc.encode(texts.slice(lo, hi - lo))
        at = 0
        for i, k in zip(range(lo, hi), n.tolist(), strict=True):
            row = flat[at : at + k]
            yield ids[i], row if end_id is None else np.append(row, np.uint32(end_id))
            at += k
        lo = hi


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
