"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary file gives pieces and scores; segmentation is done here. Symbols are merged by an agenda: the adjacent
pair whose joined piece scores highest first, the leftmost at ties. Under dropout each occurrence of a chunk skips each
candidate merge, when it is taken from the agenda, with the rate as probability and independently of all others. The
draws are keyed hashes of (seed, document's id, place of the chunk in its text, number of the draw), so a run repeats
itself exactly on any machine and with any partitioning. Rate 0 gives the library's own segmentation.

No piece continues across the begin of a space run or over a line feed, and none has a letter next to a mark, so texts
are cut there into chunks. A draw gives the distance to the next skipped candidate (geometric), so an occurrence whose
first skip lies behind the last candidate has the plain segmentation. Only that one is cached; others replay its merges
up to their first skip and are segmented from there.

Characters outside the vocabulary become byte pieces, and so does a literal U+2581, which would otherwise decode as a
space: decoding returns every text as it was. Null and empty texts have no pieces; a null id counts as an id of its own;
repeated rows get equal pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from array import array
from collections.abc import Container, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary_path

DROPOUT = 0.1
SEED = 17
#: Plain segmentations in each of the two generations that a Python worker keeps (about 300 bytes each).
CACHED_CHUNKS = 400_000
SLICE_CHARS = 4_000_000
#: Chunks of more characters are segmented one occurrence at a time, with no cache.
LONG_CHUNK = 63
#: Distances that one draw tells apart; a longer one goes on with the next draw. More than the candidates of a cached chunk.
DISTANCES = 4096

_MASK = (1 << 64) - 1
_CUT = "\x1f"
#: No letters, spaces or marks: the other control characters but tab and line feed, then those for private use.
_OTHER_CUTS = [*range(1, 9), *range(14, 31), *range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]
#: Marks between which and a letter chunks are cut, where the vocabulary has no piece with the two next to each other.
_MARKS = ".,;:!?#$%&*|\"'()"


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Distances to the next skip: geometric, from integer thresholds, so alike on any machine."""

    def __init__(self, rate: float) -> None:
        left, keep = [], 1.0
        while len(left) < DISTANCES and (keep := keep * (1.0 - rate)) * (1 << 53) >= 1:
            left.append(int(keep * (1 << 53)))  # the distance is longer if the draw is less
        self.most = len(left)
        self.left = np.array(left[::-1], np.uint64)

    def keys(self, seed: int, doc_keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = _scramble(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _MASK))
            return _scramble(doc_keys + own)

    def distance(self, keys: np.ndarray, nth: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            draw = _scramble(keys + np.uint64(0xD6E8FEB86659FD93) * (np.asarray(nth).astype(np.uint64) + np.uint64(1))) >> np.uint64(11)
        return self.most - np.searchsorted(self.left, draw, "right")

    def skips(self, key: np.ndarray, upto: int) -> set[int]:
        """All skips of one occurrence under ``upto``."""
        out, at, nth = [], 0, 0
        while at < upto:
            far = self.distance(key, np.arange(nth, nth + 256))
            nth += 256
            told = far < DISTANCES
            end = at + np.cumsum(far + told)
            out.extend((end - 1)[told].tolist())
            at = int(end[-1])
        return set(out)


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        score: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        raw: list[bytes] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                score[piece] = (-sp.get_score(i), i)
                raw.append(piece.replace("▁", " ").encode())
        order = sorted(score, key=score.__getitem__)  # best first
        self.rank = {p: r for r, p in enumerate(order)}
        self.length = [len(p) for p in order]
        self.piece_id = [score[p][1] for p in order]
        self.ids = {p: score[p][1] for p in order}
        mixed = {c for p in score for a, b in zip(p, p[1:], strict=False) for c in (a, b) if a.isalpha() != b.isalpha()}
        marks = "".join("\\" + c for c in _MARKS if c not in mixed)
        self.cuts = [(rf"(\pL)([{marks}])", rf"\1{_CUT}\2"), (rf"([{marks}])(\pL)", rf"\1{_CUT}\2")] if marks else []
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array(list(map(len, raw)), np.int64)
        self.raw_first = np.cumsum(self.raw_length) - self.raw_length
        self.draws: dict[float, Draws] = {}
        self.young: dict[str, tuple[bytes, int, bytes]] = {}
        self.old: dict[str, tuple[bytes, int, bytes]] = {}

    def segment(
        self, chunk: str, skips: Container[int] = (), path: bytes = b"", walked: bytearray | None = None,
    ) -> tuple[list[int], int]:
        """The piece ids of one chunk (spaces as spaces) and the number of candidates that the agenda gave; those whose
        numbers are in ``skips`` are not merged.

        Up to ``LONG_CHUNK`` characters the agenda is the list of the ranks of all adjacent pairs; longer chunks have a heap.
        ``path`` has the places of merges before the first skip, which are replayed; the places of all are put in ``walked``.
        """
        text = chunk
        if "▁" in text:
            text = text.replace("▁", "\ufffe")  # a literal mark joins with nothing
        if " " in text:
            text = text.replace(" ", "▁")
        if len(text) > LONG_CHUNK:
            return self._by_heap(chunk, text, skips)
        rank, none, taken = self.rank.get, self.size, len(path)
        parts = list(text)
        for i in path:
            parts[i] += parts.pop(i + 1)
        ranks = [rank(a + b, none) for a, b in pairwise(parts)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            taken += 1
            if skips and taken - 1 in skips:
                ranks[i] = none
                continue
            if walked is not None:
                walked.append(i)
            del ranks[i]
            piece = parts[i] = parts[i] + parts.pop(i + 1)
            if i < len(ranks):
                ranks[i] = rank(piece + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + piece, none)
        try:
            return [self.ids[p] for p in parts], taken
        except KeyError:
            out, at = [], 0
            for p in parts:
                if p in self.ids:
                    out.append(self.ids[p])
                else:
                    out.extend(self.byte_id[b] for b in chunk[at : at + len(p)].encode("utf-8", "surrogatepass"))
                at += len(p)
            return out, taken

    def _by_heap(self, chunk: str, text: str, skips: Container[int]) -> tuple[list[int], int]:
        """The agenda holds the rank and place (in one integer) of each adjacent pair that joins to a piece; symbols are spans of the chunk,
        of which only boundaries vanish, so an entry is stale when its place is gone or its span has another length."""
        n, rank, length, push, pop = len(text), self.rank.get, self.length, heapq.heappush, heapq.heappop
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = n.bit_length()
        low = (1 << bits) - 1
        taken = 0
        agenda = [r << bits | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            i = entry & low
            j = right[i]
            if not j or j >= n:
                continue
            end = right[j]
            if end - i != length[entry >> bits]:
                continue
            taken += 1
            if skips and taken - 1 in skips:
                continue
            right[i], right[j] = end, 0
            if end < n:
                left[end] = i
                r = rank(text[i : right[end]])
                if r is not None:
                    push(agenda, r << bits | i)
            k = left[i]
            if k >= 0:
                r = rank(text[k:end])
                if r is not None:
                    push(agenda, r << bits | k)
        out, i = [], 0
        while i < n:
            end = right[i]
            r = rank(text[i:end])
            if r is None:
                out.extend(self.byte_id[b] for b in chunk[i:end].encode("utf-8", "surrogatepass"))
            else:
                out.append(self.piece_id[r])
            i = end
        return out, taken

    def _plain(self, chunk: str) -> tuple[bytes, int, bytes]:
        """The ids of a chunk without skips, its number of candidates and their places, from the cache if it is there."""
        held = self.young.get(chunk)
        if held is None:
            held = self.old.get(chunk)
            if held is None:
                walked = bytearray()
                ids, taken = self.segment(chunk, (), b"", walked)
                held = array("I", ids).tobytes(), taken, bytes(walked)
            if len(chunk) <= LONG_CHUNK:
                self.young[chunk] = held
        return held

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text. A text that holds the cut character is cut with another one, at the same places."""
        own = pc.match_substring(texts, _CUT)
        if not pc.any(own).as_py():
            return self._cut(texts, _CUT)
        parts, at = [], 0
        for i in np.flatnonzero(own.to_numpy(zero_copy_only=False)).tolist():
            held = set(texts[i].as_py())
            parts.append(self._cut(texts.slice(at, i - at), _CUT))
            parts.append(self._cut(texts.slice(i, 1), next(c for c in map(chr, _OTHER_CUTS) if c not in held)))
            at = i + 1
        return pa.concat_arrays([*parts, self._cut(texts.slice(at), _CUT)])

    def _cut(self, texts: pa.Array, mark: str) -> pa.Array:
        some = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        some = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), some)
        cut = pc.replace_substring(pc.replace_substring_regex(some, " +", mark + "\\0"), "\n", f"{mark}\n{mark}")
        for pattern, into in self.cuts:
            cut = pc.replace_substring_regex(cut, pattern, into.replace(_CUT, mark))
        return pc.split_pattern(cut, mark)

    def encode(
        self, texts: pa.Array, doc_keys: np.ndarray, rate: float, seed: int, cached_chunks: int = CACHED_CHUNKS,
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large strings, none null) in a row, and the number of ids of each text."""
        split = self._chunks(texts)
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = split.flatten()
        coded = chunks.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        if len(self.young) > cached_chunks:  # what was not used since the last time is forgotten
            self.young, self.old = {}, self.young
        found, taken, paths = map(list, zip(*map(self._plain, words), strict=True)) if words else ([], [], [])
        kinds = [(w, (), p) for w, p in zip(words, paths, strict=True)]
        if rate:
            draws = self.draws.get(rate) or self.draws.setdefault(rate, Draws(rate))
            place = np.arange(len(at)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            keys = draws.keys(seed, np.repeat(doc_keys, per_text), place)
            skip, nth = draws.distance(keys, 0), 0
            rows = np.flatnonzero(skip < np.array(taken, np.int64)[at])
            skip = skip[rows]
            long = np.fromiter((len(w) > LONG_CHUNK for w in words), bool, len(words))[at[rows]] if len(rows) else np.zeros(0, bool)
            for r in rows[long].tolist():
                word = words[at[r]]
                at[r] = len(found)
                # every merge ends two candidates' lives and begins two at most
                found.append(array("I", self.segment(word, draws.skips(keys[r], 3 * len(word) + 3))[0]).tobytes())
                taken.append(0)
                kinds.append((word, (), b""))
            rows, skip = rows[~long], skip[~long]
            while len(rows):
                nth += 1
                width = int(skip.max()) + 1
                fresh, own = np.unique(at[rows] * width + skip, return_inverse=True)
                at[rows] = own + len(found)
                begin = len(taken)
                for k in fresh.tolist():
                    word, before, path = kinds[k // width]
                    skips = (*before, k % width)
                    ids, n = self.segment(word, skips, path[: skips[0]])
                    kinds.append((word, skips, path))
                    found.append(array("I", ids).tobytes())
                    taken.append(n)
                skip = skip + 1 + draws.distance(keys[rows], nth)
                more = skip < np.array(taken[begin:], np.int64)[own]
                rows, skip = rows[more], skip[more]
        flat = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = np.cumsum(length) - length, length[at]
        ids = flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()), dtype=np.int64)]
        upto = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per_text)]]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts before it."""
        n = self.raw_length[ids]
        total = int(n.sum())
        if not total:
            return ""
        out = self.raw[np.repeat(self.raw_first[ids] - (np.cumsum(n) - n), n) + np.arange(total)]
        return out[1:].tobytes().decode("utf-8", "surrogatepass")


_VOCABULARIES: dict[tuple[str, float, int], Vocabulary] = {}


def vocabulary(path: str, rate: float, seed: int) -> Vocabulary:
    """The vocabulary of this Python worker with its cache for these settings."""
    if (path, rate, seed) not in _VOCABULARIES:
        _VOCABULARIES[path, rate, seed] = Vocabulary(path)
    return _VOCABULARIES[path, rate, seed]


def _runs(batch: pa.RecordBatch, path: str, rate: float, seed: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """(row, text, ids) of each row of a batch (id, text, key)."""
    voc = vocabulary(path, rate, seed)
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(texts):
        hi, used = lo + 1, int(size[lo])
        while hi < len(texts) and used + size[hi] <= SLICE_CHARS:
            used += int(size[hi])
            hi += 1
        part = texts.slice(lo, hi - lo)
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            flat, n = voc.encode(part, keys[lo:hi], rate, seed)
        finally:
            if collecting:
                gc.enable()
        at = 0
        for i, text, k in zip(range(lo, hi), part.to_pylist(), n.tolist(), strict=True):
            yield i, text, flat[at : at + k]
            at += k
        lo = hi


def _prepared(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("key")
    )


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = DROPOUT, seed: int = SEED,
    model: str | None = None,
) -> DataFrame:
    """Per row: id, ids (array of piece ids)."""
    path = model or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.astype(np.int32) for _, _, x in _runs(b, path, rate, seed)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = _prepared(docs, id_col, text_col, seed)
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: id, text."""
    path = model or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, 0.0, 0)
        for b in batches:
            text = [None if x is None else voc.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = DROPOUT, seed: int = SEED,
    model: str | None = None,
) -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), lossless (decoding gives the text back)."""
    path = model or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            voc = vocabulary(path, rate, seed)
            rows = [(len(x), zlib.crc32(x.astype("<u4").tobytes()), voc.decode(x) == t) for _, t, x in _runs(b, path, rate, seed)]
            n, crc, same = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=["id", "n_pieces", "ids_crc32", "lossless"],
            )

    rows = _prepared(docs, id_col, text_col, seed)
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, lossless boolean")
    return out.withColumnRenamed("id", id_col)
