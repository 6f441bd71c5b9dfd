"""Collocations: phrases of 2 to ``max_words`` words whose words occur together more often than their parts would.

Method: an FM-index per shard over word ids. A shard is a run of texts; its words get ids, and words and
pairs under the threshold become breaks (no frequent phrase holds one). The sequence is sorted by its next ``max_words`` ids in both
directions, which gives two Burrows-Wheeler transforms. A phrase of a shard is a pair of intervals of equal length. All
phrases of a length are extended at once: to the right in the backward index and to the left in the forward index. An
extension counts where both directions reach the same forward interval, that is, where its first words and its last
words are both frequent phrases, and the two directions name these. Counts are summed across shards; only phrases that reach the
threshold in the whole group are extended by the shards, two words at a time, so two lengths are one shuffle of phrases, never of occurrences.

Counts of words, pairs and phrases travel as compressed lists, never as rows: each shard sends sorted 64-bit hashes with counts to blocks
of the hash range, the blocks add them up and answer with the places that are left (:mod:`.sieve`). The hash of a word or phrase is its
number (10 million frequent ones share one with a probability of 3 in a million); pairs are thinned by 36 bits of theirs before the index is
built, and counted by all bits after it. The index is sent to its shard's task once for two lengths. The first shard that has a phrase spells
it: it has all its parts and every phrase of one word more that occurs as often, so no phrases are joined. No shard or task holds
more than its own shard or block, and nothing is collected or broadcast.

Defined cases: null texts are empty; a null lang is ``und``; ids play no part, so repeated rows count as often as they
occur; an empty table, or one with no frequent phrase, gives no rows; other columns are ignored. Ties at the end of a
report are cut by the order (score, count, phrase), which is total.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as wd
from .sieve import LISTS, block_bits, left, lists, sieve
from .store import dropped, written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000

_NAMES = "langs array<string>, spelled binary, n_bytes long, lang_of binary, f binary"
_NAMES_TYPE = [("langs", pa.list_(pa.string())), ("spelled", pa.binary()), ("n_bytes", pa.int64()), ("lang_of", pa.binary()), ("f", pa.binary())]
_GROWN = "shard long, gids binary, n_gids long, grams binary, size long, longer binary, n_longer long"
_GROWN_TYPE = [("shard", pa.int64()), ("gids", pa.binary()), ("n_gids", pa.int64()), ("grams", pa.binary()), ("size", pa.int64()), ("longer", pa.binary()), ("n_longer", pa.int64())]
_LEFT = "words int, named binary, sums binary, owner binary, n_named long"
_LEFT_TYPE = [("words", pa.int32()), ("named", pa.binary()), ("sums", pa.binary()), ("owner", pa.binary()), ("n_named", pa.int64())]


def _row(schema: pa.Schema, **values: object) -> pa.Table:
    """One row; the columns that are not given are null."""
    return pa.table([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _shards(docs: DataFrame) -> DataFrame:
    """Per shard: its sequence of local word numbers (0: break), its langs with their numbers of words, and of each local word the
    spelling, the count and the lang's place."""
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())),
                        ("spelled", pa.binary()), ("size", pa.int64()), ("counts", pa.binary()), ("lang_of", pa.binary()), ("n_local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in batches:
            texts, langs = wd.plain(b.column(0)), pc.fill_null(b.column(1), "und").dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi in wd.slices(texts):
                some = wd.split(texts.slice(lo, hi - lo))
                at, found = wd.coded(some)
                if not len(at):
                    continue
                pair, own, n = np.unique(at * len(names) + lang[lo:hi][some.text], return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")  # small numbers for frequent words
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(1, len(order) + 1)
                pair, n = pair[order], n[order]
                ids = np.zeros(len(at) + int(some.broken.sum()) + 1, np.int32)
                ids[np.arange(len(at)) + np.cumsum(some.broken)] = place[own]
                spelled = "\n".join(found[i] for i in pair // len(names)).encode()
                lang_of = (pair % len(names)).astype(np.int32)
                row = [wd.shard_number(TaskContext.get().partitionId(), nth), wd.packed(ids), len(ids), names, np.bincount(lang_of, n, len(names)).astype(np.int64),
                       pa.compress(spelled, "zstd", asbytes=True), len(spelled), wd.packed(n), wd.packed(lang_of), len(n)]
                nth += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "shard long, ids binary, n long, langs array<string>, totals array<long>, spelled binary, size long, counts binary, "
                                "lang_of binary, n_local long")


def _local_words(spelled: bytes, size: int, lang_of: bytes, n_local: int, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a shard, the lang's place of each, and the hash of both."""
    words = pa.decompress(spelled, size, "zstd", asbytes=True).decode().split("\n")
    lang = wd.unpacked(lang_of, n_local)
    heads = [f"{x}\n" for x in langs]
    return words, lang, np.fromiter((xxhash.xxh3_64_intdigest(heads[i] + w) for w, i in zip(words, lang.tolist(), strict=True)), np.uint64, len(words))


def sorted_contexts(ids: np.ndarray, depth: int) -> np.ndarray:
    """The places of a sequence, sorted by the ``depth`` ids from there on; ties in any fixed order."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    own = ids.astype(np.int64)
    keys, at = [], 0
    while at < depth:
        key = np.zeros(len(ids), np.int64)
        for j in range(at, min(depth, at + 62 // bits)):
            key = key << bits
            key[: len(ids) - j] |= own[j:]
        keys.append(key)
        at += 62 // bits
    return np.lexsort(keys[::-1])


class Index:
    """The two transforms of one shard, forward and backward, and where each symbol begins."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.forward, self.backward = forward, backward
        count = np.bincount(forward) if len(forward) else np.zeros(1, np.int64)
        self.first = np.cumsum(count) - count
        self.count = count

    @classmethod
    def of(cls, ids: np.ndarray, depth: int) -> Index:
        """``ids`` begin and end with a break (0)."""
        after = sorted_contexts(ids, depth)
        back = len(ids) - 1 - sorted_contexts(ids[::-1], depth)
        return cls(ids[after - 1], ids[(back + 1) % len(ids)])

    @staticmethod
    def _steps(bwt: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-symbol extensions of disjoint intervals: (interval, symbol, its first place in the interval, count, number of
        smaller symbols in the interval)."""
        node = np.repeat(np.arange(len(begin)), n)
        upto = np.cumsum(n)
        place = np.arange(len(node)) + np.repeat(begin - (upto - n), n)
        symbol = bwt[place]
        order = np.argsort(node * (int(bwt.max(initial=0)) + 1) + symbol, kind="stable")
        node, symbol, place = node[order], symbol[order], place[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
        cut = np.flatnonzero(new)
        node, symbol = node[cut], symbol[cut]
        count = np.diff(np.r_[cut, len(order)])
        smaller = cut - (upto - n)[node]
        some = symbol > 0
        return node[some], symbol[some], place[cut][some], count[some], smaller[some]

    @staticmethod
    def _ranks(bwt: np.ndarray) -> np.ndarray:
        """Last-to-first mapping: the interval of a symbol before a context begins where its first occurrence maps to."""
        out = np.empty(len(bwt), np.int64)
        out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        return out

    def extend(self, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrases (forward begin, backward begin, length of both intervals) to all phrases of one word more whose first words and
        last words are among them: (number of the first words, number of the last words, forward begin, backward begin, count)."""
        head, _, place, count, smaller = self._steps(self.backward, rlo, n)
        right_lo, right_rlo = lo[head] + smaller, self._ranks(self.backward)[place]
        tail, _, place, _, _ = self._steps(self.forward, lo, n)
        left_lo = self._ranks(self.forward)[place]
        _, a, b = np.intersect1d(right_lo, left_lo, assume_unique=True, return_indices=True)
        return head[a], tail[b], right_lo[a], right_rlo[a], count[a]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in this order."""
    with np.errstate(over="ignore"):
        mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(29))


def _twice(index: Index, gids: np.ndarray, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray, again: bool) -> dict[str, object]:
    """The phrases of one word more, and (``again``) of two words more than those whose hashes are ``gids``, as columns: (number of the first
    words, number of the last words, both begins, count). A phrase that is rare everywhere makes no frequent one, so none is
    lost or counted wrongly if it is extended before the sieve."""
    grown = index.extend(lo, rlo, n)
    longer = index.extend(*grown[2:]) if again else [np.zeros(0, np.int64)] * 5
    return {"gids": wd.packed(gids), "n_gids": len(gids), "grams": wd.packed(np.concatenate(grown).astype(np.int32)), "size": len(grown[0]),
            "longer": wd.packed(np.concatenate(longer).astype(np.int32)), "n_longer": len(longer[0])}


def _grams(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both kinds of phrases of a row of :func:`_twice`, and the hashes of each kind."""
    gids = wd.unpacked(r["gids"], r["n_gids"], "<u8")
    grams, longer = (wd.unpacked(r[c], 5 * r[n]).reshape(5, -1) for c, n in (("grams", "size"), ("longer", "n_longer")))
    hashes = _mixed(gids[grams[0]], gids[grams[1]])
    return grams, longer, hashes, _mixed(hashes[longer[0]], hashes[longer[1]])


def _word_lists(shards: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hashes = _local_words(r["spelled"], r["size"], r["lang_of"], r["n_local"], r["langs"])[2]
                yield lists(r["shard"], hashes, wd.unpacked(r["counts"], r["n_local"], "<i8"), bits)

    return shards.select("shard", "spelled", "size", "lang_of", "n_local", "langs", "counts").mapInArrow(run, LISTS)


def _collapsed(ids: np.ndarray) -> np.ndarray:
    """One break in place of many, and breaks at both ends."""
    ids = np.r_[np.int32(0), ids, np.int32(0)].astype(np.int32)
    return ids[np.r_[True, (ids[1:] > 0) | (ids[:-1] > 0)]]


def _sequences(shards: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """Per shard its sequence over its frequent words, and of each of these the hash, spelling, lang's place and count."""
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("gids", pa.binary()), ("n_gids", pa.int64()), *_NAMES_TYPE])

    def run(own_rows: pa.Table, right: pa.Table) -> pa.Table:
        if not own_rows.num_rows or not right.num_rows:
            return schema.empty_table()
        r = own_rows.to_pylist()[0]
        words, lang, hashes = _local_words(r["spelled"], r["size"], r["lang_of"], r["n_local"], r["langs"])
        own, sums, _ = left(hashes, right, bits)
        order = np.argsort(own)  # small numbers for frequent words
        own, sums = own[order], sums[order]
        symbol = np.zeros(len(words) + 1, np.int32)
        symbol[own + 1] = np.arange(1, len(own) + 1)
        ids = _collapsed(symbol[wd.unpacked(r["ids"], r["n"])])
        spelled = "\n".join(words[i] for i in own).encode()
        return _row(schema, shard=r["shard"], ids=wd.packed(ids), n=len(ids), gids=wd.packed(hashes[own]), n_gids=len(own), langs=r["langs"],
                    spelled=pa.compress(spelled, "zstd", asbytes=True), n_bytes=len(spelled), lang_of=wd.packed(lang[own]), f=wd.packed(sums))

    return shards.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(
        run, f"shard long, ids binary, n long, gids binary, n_gids long, {_NAMES}")


def _pairs(ids: np.ndarray, gids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places begin a pair of words, the pair of each, and the hash of each distinct pair."""
    begin = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    pair, own = np.unique(ids[begin].astype(np.int64) << 32 | ids[begin + 1], return_inverse=True)
    mixed = _mixed(*(gids[x - 1] for x in (pair >> 32, pair & 0xFFFFFFFF)))
    return begin, own, mixed & ~np.uint64((1 << 28) - 1)  # 36 bits are enough to thin them


def _pair_lists(sequences: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, own, hashes = _pairs(wd.unpacked(r["ids"], r["n"]), wd.unpacked(r["gids"], r["n_gids"], "<u8"))
                hashes, same = np.unique(hashes, return_inverse=True)
                yield lists(r["shard"], hashes, np.bincount(same[own], minlength=len(hashes)), bits)

    return sequences.select("shard", "ids", "n", "gids", "n_gids").mapInArrow(run, LISTS)


def _names_of(r: dict, used: np.ndarray) -> dict[str, object]:
    """The columns that name the words of a shard, for some of them."""
    words = pa.decompress(r["spelled"], r["n_bytes"], "zstd", asbytes=True).split(b"\n")
    spelled = b"\n".join(words[i] for i in used)
    return {"langs": r["langs"], "spelled": pa.compress(spelled, "zstd", asbytes=True), "n_bytes": len(spelled),
            "lang_of": wd.packed(wd.unpacked(r["lang_of"], r["n_gids"])[used]), "f": wd.packed(wd.unpacked(r["f"], r["n_gids"], "<i8")[used])}


def _built(sequences: DataFrame, kept: DataFrame, depth: int, bits: int) -> DataFrame:
    """Per shard its index, its phrases of two and three words, and the names of its words."""
    schema = pa.schema([*_GROWN_TYPE, ("n", pa.int64()), ("forward", pa.binary()), ("backward", pa.binary()), *_NAMES_TYPE])

    def run(own_rows: pa.Table, right: pa.Table) -> pa.Table:
        if not own_rows.num_rows or not right.num_rows:
            return schema.empty_table()
        r = own_rows.to_pylist()[0]
        ids, gids = wd.unpacked(r["ids"], r["n"]), wd.unpacked(r["gids"], r["n_gids"], "<u8")
        begin, own, hashes = _pairs(ids, gids)
        different, same = np.unique(hashes, return_inverse=True)
        frequent = np.zeros(len(different), bool)
        frequent[left(different, right, bits)[0]] = True
        begin = begin[frequent[same[own]]]
        linked = np.zeros(len(ids), bool)  # to the next word
        linked[begin] = True
        inside = linked.copy()
        inside[begin + 1] = True
        held = np.flatnonzero(inside)
        after = np.zeros(len(held), np.int64)  # a break after each word that is not linked to the next
        after[1:] = np.cumsum(~linked[held])[:-1]
        thin = np.zeros(len(held) + int((~linked[held]).sum()) + 1, np.int32)
        used, own = np.unique(ids[held], return_inverse=True)
        thin[np.arange(len(held)) + after + 1] = own + 1
        index = Index.of(_collapsed(thin), depth)
        first, count, used = index.first[1:], index.count[1:], used - 1
        return _row(schema, shard=r["shard"], n=len(index.forward), forward=wd.packed(index.forward), backward=wd.packed(index.backward),
                    **_twice(index, gids[used], first, first, count, depth > 2), **_names_of(r, used))

    return sequences.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(run, f"{_GROWN}, n long, forward binary, backward binary, {_NAMES}")


def _gram_lists(grown: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                grams, longer, *hashes = _grams(r)
                yield lists(r["shard"], np.concatenate(hashes), np.concatenate([grams[4], longer[4]]), bits)

    return grown.select("shard", "gids", "n_gids", "grams", "size", "longer", "n_longer").mapInArrow(run, LISTS)


def _left(rows: DataFrame, kept: DataFrame, words: int, most: int, bits: int) -> DataFrame:
    """Per shard and number of words (``words`` and one more) which of its phrases the sieve left: the numbers of their first and last words
    among the phrases left before (``named``), the sums, and whether the shard is the first that has it. In the row of the longer ones
    also, up to ``most`` words, the phrases of one and two words more."""
    schema = pa.schema([*_GROWN_TYPE, *_LEFT_TYPE])

    def run(own_rows: pa.Table, right: pa.Table) -> pa.Table:
        if not own_rows.num_rows or not right.num_rows:
            return schema.empty_table()
        r = own_rows.to_pylist()[0]
        grams, longer, hashes, hashes_longer = _grams(r)
        own, sums, owner = left(np.concatenate([hashes, hashes_longer]), right, bits)
        order = np.argsort(own)
        own, sums, owner = own[order], sums[order], owner[order].astype(np.int32)
        k = int(np.searchsorted(own, len(hashes)))
        place = np.full(len(hashes), -1, np.int32)
        place[own[:k]] = np.arange(k)
        grams, longer = grams[:, own[:k]], longer[:, own[k:] - len(hashes)]
        out = [_row(schema, shard=r["shard"], words=words, named=wd.packed(grams[:2].ravel()), sums=wd.packed(sums[:k]), owner=wd.packed(owner[:k]), n_named=k)]
        if len(own) > k:
            more = {}
            if words + 1 < most:
                index = Index(wd.unpacked(r["forward"], r["n"]), wd.unpacked(r["backward"], r["n"]))
                more = _twice(index, hashes_longer[own[k:] - len(hashes)], *longer[2:].astype(np.int64), words + 2 < most)
            out.append(_row(schema, shard=r["shard"], words=words + 1, named=wd.packed(place[longer[:2]].ravel()), sums=wd.packed(sums[k:]),
                            owner=wd.packed(owner[k:]), n_named=len(own) - k, **more))
        return pa.concat_tables(out)

    return rows.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(run, f"{_GROWN}, {_LEFT}")


def _spelled(names: DataFrame, levels: DataFrame) -> DataFrame:
    """The phrases, each from the first shard that has it. This shard has all their parts; a phrase of one word more that occurs as
    often follows or precedes every occurrence, so the shard has it too."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()), ("heads", pa.list_(pa.int64())),
                        ("tails", pa.list_(pa.int64())), ("closed", pa.bool_())])

    def run(own_rows: pa.Table, right: pa.Table) -> pa.Table:
        if not own_rows.num_rows or not right.num_rows:
            return schema.empty_table()
        r = own_rows.to_pylist()[0]
        spelled = pa.array(pa.decompress(r["spelled"], r["n_bytes"], "zstd", asbytes=True).decode().split("\n"), pa.large_string())
        langs, lang_of = pa.array(r["langs"], pa.string()), wd.unpacked(r["lang_of"], r["n_gids"])
        sums, heads, tails, owners = [wd.unpacked(r["f"], r["n_gids"], "<i8")], [None], [None], [None]
        for x in sorted(right.to_pylist(), key=lambda x: x["words"]):
            k = x["n_named"]
            head, tail = wd.unpacked(x["named"], 2 * k).reshape(2, -1)
            sums.append(wd.unpacked(x["sums"], k, "<i8"))
            heads.append(head)
            tails.append(tail)
            owners.append(wd.unpacked(x["owner"], k) > 0)
        out = []
        for at in range(1, len(sums)):
            own = np.flatnonzero(owners[at])
            closed = np.ones(len(sums[at]), bool)
            if at + 1 < len(sums):
                for part in (heads[at + 1], tails[at + 1]):
                    closed[part[sums[at][part] == sums[at + 1]]] = False
            by_head, by_tail, words = [sums[at][own]], [sums[at][own]], []
            first, last = own, own
            for lower in range(at, 0, -1):
                rest = last
                for under in range(lower, 0, -1):  # the first word of what is left
                    rest = heads[under][rest]
                words.append(rest)
                first, last = heads[lower][first], tails[lower][last]
                by_head.insert(0, sums[lower - 1][first])
                by_tail.append(sums[lower - 1][last])
            words.append(last)
            size = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (at + 1))
            counts = [pa.ListArray.from_arrays(size, pa.array(np.stack(x, axis=1).ravel())) for x in (by_head, by_tail)]
            phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(w)) for w in words], pa.scalar(" ", pa.large_string())).cast(pa.string())
            out.append(pa.table([langs.take(pa.array(lang_of[words[0]])), phrase, pa.array(np.full(len(own), at + 1, np.int32)), pa.array(sums[at][own]), *counts,
                                 pa.array(closed[own])], schema=schema))
        return pa.concat_tables(out)

    return names.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(
        run, "lang string, phrase string, words int, a long, heads array<long>, tails array<long>, closed boolean")


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``max_words`` words that occur ``min_count`` times in their lang, and the number of words of each lang.

    Phrases: lang, phrase, words (their number), a (count), heads (counts of the first 1, 2, ... words up to the phrase),
    tails (counts of the phrase, and of what is left without its first 1, 2, ... words), closed (no phrase of one
    word more that holds it occurs as often).
    """
    t = written(_shards(docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))), "phrase-shards")
    totals = written(t.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("total")), "phrase-langs")
    bits = block_bits(t.count())
    sequences = written(_sequences(t, sieve(_word_lists(t, bits), min_count), bits), "phrase-words", tidy=True)
    dropped(t)
    built = written(_built(sequences, sieve(_pair_lists(sequences, bits), min_count), max_words, bits), "phrase-index", tidy=True)
    dropped(sequences)
    grown, levels = built, []
    for words in range(2, max_words + 1, 2):
        rows = grown.select("shard", "gids", "n_gids", "grams", "size", "longer", "n_longer")
        if words + 1 < max_words:
            rows = rows.join(built.select("shard", "n", "forward", "backward"), "shard") if levels else built.drop(*[c for c, _ in _NAMES_TYPE])
        some = written(_left(rows, sieve(_gram_lists(grown, bits), min_count), words, max_words, bits), f"phrase-{words}", tidy=True)
        levels.append(some.filter("words IS NOT NULL").select("shard", "words", "named", "sums", "owner", "n_named"))
        grown = some.filter("gids IS NOT NULL")
    names = built.select("shard", "n_gids", *[c for c, _ in _NAMES_TYPE])
    found = written(_spelled(names, reduce(DataFrame.unionAll, levels)), "phrase-names", tidy=True)
    dropped(built)
    return found, totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
) -> DataFrame:
    """The ``top`` closed phrases of each lang by score: lang, rank, phrase, a, l, r, n, score.

    The score of a cut after k words is floor(1000 * a * n / (l * r)) in exact integers (38 digits); the lowest counts,
    and the first of equal ones.
    """
    found, totals = phrase_counts(docs, text_col, lang_col, min_count, max_words)
    whole = "CAST({} AS DECIMAL(38, 0))".format
    cut = f"""transform(sequence(1, words - 1), k -> struct(
        (CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(total AS DECIMAL(16, 0))) div ({whole('heads[k - 1]')} * {whole('tails[k]')}) AS score,
        k AS k, heads[k - 1] AS l, tails[k] AS r))"""
    scored = found.filter("closed").join(totals, "lang").withColumn("_cut", F.array_min(F.expr(cut)))
    best = scored.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("total").alias("n"), F.col("_cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
), pieces AS (
    SELECT lang, unnest(string_split_regex(body, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts
), sequences AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), places AS (
    SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM sequences
), grams AS (
    SELECT lang, ws[i : i + k - 1] AS gram, k FROM places, generate_series(1, {MAX_WORDS}) AS t(k) WHERE i + k - 1 <= len(ws)
), counts AS MATERIALIZED (
    SELECT lang, gram, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM sequences GROUP BY lang
), kept AS (
    SELECT * FROM counts c
    WHERE k >= 2 AND NOT EXISTS (
        SELECT 1 FROM counts b
        WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.f >= 100 * c.f
          AND contains(' ' || array_to_string(b.gram, ' ') || ' ', ' ' || array_to_string(c.gram, ' ') || ' '))
), cuts AS (
    SELECT c.lang, c.gram, c.f AS a, t.n, x.f AS l, y.f AS r, p.k AS cut,
           (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
    FROM kept c JOIN totals t ON t.lang = c.lang, generate_series(1, {MAX_WORDS - 1}) AS p(k)
    JOIN counts x ON x.lang = c.lang AND x.gram = c.gram[1 : p.k]
    JOIN counts y ON y.lang = c.lang AND y.gram = c.gram[p.k + 1 :]
    WHERE p.k < c.k
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS nth FROM cuts
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank,
           array_to_string(gram, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM best WHERE nth = 1
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
