"""Alignment of two tokenizers on the same texts: where their tokens end together.

A is a byte-level BPE vocabulary, B a piece vocabulary with byte fallback. Both encode a space and the text; byte offsets
at which tokens of both end cut the two sequences into groups, and the tokens that end there are linked.

Method: an identity map gives each A id the B id with the same bytes. A group of one A and one B token that the map
holds is counted in a vector as long as A's vocabulary, one for each task; only irregular links take part in the pair shuffle, as one row
for each distinct pair of a shard (a run of texts) with its count. Their corpus counts come back to the shards; the vectors
are summed and handed out with a bound: the two vocabularies' lengths. So no text, link or document is shuffled by a pair, and a
pair that a third of all links hold has one row per shard.

Defined cases: texts that are null, empty, or that B does not give back byte by byte (those that hold its mark for
spaces, U+2581) have no tokens: zeros and ''. Ids may be null or repeat: one row per row. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as wd
from .pieces import vocabulary
from .store import written
from .tokens import vocabulary_path

_MARK = "▁"
_CUT = "\x1f"
#: The cutter of A's vocabulary ends a token between a letter and these marks, and between a letter, digit or mark and a space.
#: An apostrophe may belong to the letters after it, so it is not among them.
_CUTS = [(r"(\pL)([.,;:!?#$%&*()])", rf"\1{_CUT}\2"), (r"([\pL\pN.,;:!?#$%&*()])([ \n])", rf"\1{_CUT}\2")]
#: Chunks in each of the two generations that a Python worker keeps (about 200 bytes a chunk).
CACHED_CHUNKS = 200_000
SLICE_BYTES = 2 << 20


class _Bytes:
    """Bytes of each id, and gathering them for many ids."""

    def __init__(self, of: list[bytes]) -> None:
        self.of = of
        self.raw = np.frombuffer(b"".join(of), np.uint8)
        self.length = np.array(list(map(len, of)), np.int64)
        self.first = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        upto = np.cumsum(n)
        kind = np.int32 if not len(n) or upto[-1] < 1 << 30 else np.int64
        place = np.repeat((self.first[ids] - (upto - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        return self.raw[place]


class _Chunked:
    """Ids of texts that are cut into chunks no token crosses: distinct chunks are encoded by a library once and cached."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    @staticmethod
    def _parts(chunks: list[str], ids: np.ndarray, mark: int) -> dict[str, bytes]:
        """The ids of each chunk, from those of all with a mark after each."""
        cut = np.flatnonzero(ids == mark) * 4
        raw = ids.astype(np.int32).tobytes()
        return {c: raw[a:z] for c, a, z in zip(chunks, [0, *(cut[:-1] + 4).tolist()], cut.tolist(), strict=True)}

    def _found(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_CHUNKS:  # what was not used since the last time is forgotten
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, chunks))
        lacking = [c for c, v in zip(chunks, found, strict=True) if v is None]
        if lacking:
            new = {c: self.old[c] for c in lacking if c in self.old}
            new.update(self._encoded([c for c in lacking if c not in new]))
            self.young.update((c, v) for c, v in new.items() if len(c) < 64)
            found = [new[c] if v is None else v for c, v in zip(chunks, found, strict=True)]
        return found

    def _ids(self, split: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = self._found(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), np.int32)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = np.cumsum(length) - length, length[at]
        upto = np.cumsum(n)
        place = np.repeat(first[at] - (upto - n), n)
        place += np.arange(len(place))
        return flat[place], np.diff(np.r_[0, upto][np.r_[0, np.cumsum(per_text)]])


class ByteEncoder(_Chunked):
    """A's ids. Chunks of a space and one run of other characters are encoded many at a time, with a line feed after each, which
    stays a token of its own; others by themselves."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        entries = sorted(self.library.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        of = [b""] * (entries[-1][1] + 1)
        for token, i in entries:
            of[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes = _Bytes(of)
        self.mark = of.index(b"\n")

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if len(c.split()) == 1 and c.split()[0] in (c, c[1:]) and not c[:1].strip(" ").isspace()]
        out = {}
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            ids = self.library.encode_batch_fast(["".join(c + "\n" for c in some)], add_special_tokens=False)[0].ids
            out.update(self._parts(some, np.array(ids), self.mark))
        rest = [c for c in chunks if c not in out]
        for c, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[c] = array("i", e.ids).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each text (large strings, none null), and their number; an empty text has none."""
        some = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        some = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), some)
        if pc.any(pc.match_substring(texts, _CUT)).as_py():  # whole texts, uncut
            found = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.int32)]), np.fromiter(map(len, found), np.int64, len(found))
        for pattern, into in _CUTS:
            some = pc.replace_substring_regex(some, pattern, into)
        return self._ids(pc.split_pattern(some, _CUT))


class PieceEncoder(_Chunked):
    """B's ids: chunks are cut as for merge-dropout, and encoded by the library many at a time between line feeds."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = vocabulary(path, 0.0, 0)
        self.mark = self.vocabulary.byte_id[10]

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        out = {c: array("i", [self.mark] * len(c)).tobytes() for c in chunks if not c.strip("\n")}
        plain = [c for c in chunks if c not in out]
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            ids = np.array(self.library.encode("\n" + "".join(c + "\n" for c in some), num_threads=1))
            out.update(self._parts(some, ids[np.argmax(ids == self.mark) + 1 :], self.mark))  # after the library's own space and the first mark
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(self.vocabulary._chunks(texts))


class Aligner:
    """Both tokenizers of a Python worker, the identity map, and the alignment of a run of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteEncoder(path_a), PieceEncoder(path_b)
        voc = self.b.vocabulary
        own = [voc.raw[f : f + n].tobytes() for f, n in zip(voc.raw_first.tolist(), voc.raw_length.tolist(), strict=True)]
        self.b_bytes = _Bytes(own)
        single = set(voc.byte_id)
        place = {own[i]: i for i in sorted(range(len(own)), key=lambda i: i not in single) if own[i]}  # byte pieces give way
        self.same = np.array([place.get(x, -1) for x in self.a.bytes.of], np.int64)
        most = max(len(self.same), len(own))
        self.digits = _Bytes([str(i).encode() + b"," for i in range(most)])

    @staticmethod
    def _ends(n: np.ndarray) -> np.ndarray:
        return np.cumsum(n)

    def _equal(self, of: _Bytes, ids: np.ndarray, n: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each text, whether the bytes of its ids are ``want`` (``size`` bytes of each text in a row)."""
        edge = np.r_[0, self._ends(n)]
        got = np.diff(np.r_[0, self._ends(of.length[ids])][edge])
        same = got == size
        keep_ids, keep_bytes = np.repeat(same, n), np.repeat(same, size)
        differ = np.flatnonzero(of.joined(ids[keep_ids]) != want[keep_bytes])
        kept = np.flatnonzero(same)
        same[kept[np.unique(np.searchsorted(self._ends(size[kept]), differ, "right"))]] = False
        return same

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list[str]]:
        """Per text: n_a, n_b, n_groups, groups_sha256; and of all links in a row: text, a, b, whether the group has one token each."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            (a, na), (b, nb) = self.a.encode(texts), self.b.encode(texts)
        finally:
            if collecting:
                gc.enable()
        a, b = a.astype(np.int64), b.astype(np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        some = size > 0
        size = size + some  # the space
        upto = self._ends(size)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        want = np.full(int(size.sum()), 32, np.uint8)
        inside = np.ones(len(want), bool)
        inside[(upto - size)[some]] = False
        want[inside] = raw[offsets[0] : offsets[-1]]
        valid = some & ~pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
        valid &= self._equal(self.a.bytes, a, na, want, size) & self._equal(self.b_bytes, b, nb, want, size)
        a, b = a[np.repeat(valid, na)], b[np.repeat(valid, nb)]
        na, nb, size = na * valid, nb * valid, size * valid
        end_a, end_b, end = self._ends(self.a.bytes.length[a]), self._ends(self.b_bytes.length[b]), self._ends(size)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        count_a, count_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        last_a, last_b = end_a == cuts[in_a], end_b == cuts[in_b]
        text = np.searchsorted(end, cuts)
        return {
            "n_a": na, "n_b": nb, "n_groups": np.bincount(text, minlength=len(texts)), "text": text, "a": a[last_a], "b": b[last_b],
            "single": (count_a == 1) & (count_b == 1),
            "groups_sha256": self._digests(a, b, in_a, in_b, count_a, count_b, last_a, last_b, na + nb),
        }

    def _digests(self, a, b, in_a, in_b, count_a, count_b, last_a, last_b, per_text) -> list[str]:
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        at_a = np.arange(len(a)) + (np.cumsum(count_b) - count_b)[in_a]
        at_b = np.arange(len(b)) + np.cumsum(count_a)[in_b]
        ids[at_a], ids[at_b] = a, b
        mark[at_a] = np.where(last_a, ord("|"), ord(","))
        mark[at_b] = np.where(last_b, ord(";"), ord(","))
        out = self.digits.joined(ids)
        end = np.cumsum(self.digits.length[ids])
        out[end - 1] = mark
        upto = np.r_[0, end][np.r_[0, np.cumsum(per_text)]].tolist()
        view = memoryview(out)
        return [hashlib.sha256(view[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(upto, upto[1:], strict=False)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _coded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Three kinds of rows. Per shard: its documents' ids and figures and its links (>= 0: an A id of the identity map, else
    -1 - number of the irregular pair in the shard). Per irregular pair of a shard: local, a, b, n. Per task and A id: same_a, n."""
    id_type = docs.schema[0].dataType
    schema = pa.schema([
        ("shard", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
        ("n_groups", pa.list_(pa.int64())), ("digest", pa.list_(pa.string())), ("links", pa.binary()),
        ("local", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("same_a", pa.int32()), ("n", pa.int64()),
    ])

    def rows(k: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        vector = np.zeros(len(both.same), np.int64)
        nth = 0
        for batch in batches:
            texts = wd.plain(batch.column(1))
            for lo, hi in wd.slices(texts, SLICE_BYTES):
                found = both.align(texts.slice(lo, hi - lo))
                a, b = found["a"], found["b"]
                same = found["single"] & (both.same[a] == b)
                vector += np.bincount(a[same], minlength=len(vector))
                pair, own, n = np.unique(a[~same] << 32 | b[~same], return_inverse=True, return_counts=True)
                links = a.copy()
                links[~same] = -1 - own
                shard = wd.shard_number(TaskContext.get().partitionId(), nth)
                nth += 1
                yield rows(1, shard=[shard], ids=[batch.column(0).slice(lo, hi - lo).to_pylist()], n_a=[found["n_a"]], n_b=[found["n_b"]],
                           n_groups=[found["n_groups"]], digest=[found["groups_sha256"]], links=[wd.packed(links.astype(np.int32))], n=[len(links)])
                if len(pair):
                    yield rows(len(pair), shard=np.full(len(pair), shard), local=np.arange(len(pair)), a=pair >> 32, b=pair & 0xFFFFFFFF, n=n)
        used = np.flatnonzero(vector)
        yield rows(len(used), same_a=used, n=vector[used])

    kinds = f"shard long, ids array<{id_type.simpleString()}>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, links binary, "
    return docs.mapInArrow(run, kinds + "local int, a int, b int, same_a int, n long")


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the contract in the README)."""
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    t = written(_coded(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), path_a, path_b), "alignment")
    id_type = t.schema["ids"].dataType.elementType
    everywhere = Window.partitionBy("a", "b")  # one row per shard
    pairs = written(t.filter(F.col("local").isNotNull()).select("shard", "local", "a", "b", "n").withColumn("count", F.sum("n").over(everywhere))
                    .select("shard", "local", "b", "count"), "alignment-pairs")
    # as many rows as the vocabularies have ids, at most
    same_count = {r.same_a: r.n for r in t.filter(F.col("same_a").isNotNull()).groupBy("same_a").agg(F.sum("n").alias("n")).collect()}
    odd_best = {r.b: r.best for r in pairs.groupBy("b").agg(F.max("count").alias("best")).collect()}
    result = pa.schema([("id", to_arrow_type(id_type)), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        ("groups_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result.empty_table()
        both = aligner(path_a, path_b)
        count = np.zeros(len(both.same), np.int64)
        best = np.zeros(len(both.b_bytes.of), np.int64)
        for a, n in same_count.items():
            count[a] = n
        for b, n in odd_best.items():
            best[b] = n
        known = both.same >= 0
        np.maximum.at(best, both.same[known], count[known])
        links = wd.unpacked(left["links"][0].as_py(), left["n"][0].as_py()).astype(np.int64)
        order = np.argsort(right["local"].to_numpy())
        odd_count, odd_b = right["count"].to_numpy()[order], right["b"].to_numpy()[order]
        plain = links >= 0
        n, b = np.empty(len(links), np.int64), np.empty(len(links), np.int64)
        n[plain], b[plain] = count[links[plain]], both.same[links[plain]]
        n[~plain], b[~plain] = odd_count[-1 - links[~plain]], odd_b[-1 - links[~plain]]
        groups = left["n_groups"][0].values.to_numpy()
        edge = np.r_[0, np.cumsum(groups)]
        per_text = lambda x: np.diff(np.r_[0, np.cumsum(x)][edge])
        return pa.table([left["ids"][0].values, left["n_a"][0].values, left["n_b"][0].values, left["n_groups"][0].values, pa.array(groups),
                         pa.array(per_text(n == best[b]).astype(np.int64)), pa.array(per_text(n)), left["digest"][0].values], schema=result)

    shards = t.filter(F.col("links").isNotNull()).select("shard", "ids", "n_a", "n_b", "n_groups", "digest", "links", "n")
    out = shards.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(
        run, f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
