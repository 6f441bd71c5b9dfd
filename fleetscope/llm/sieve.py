"""Counts of many distinct things over shards, when most are rare: sorted 64-bit hashes with counts travel as compressed lists to
blocks of the hash range, which add them up and answer each list with what is left and its sums.

A list takes a few bytes an entry, a row of a table some 30. A thing has one entry in each shard at most, so no block is
large because one thing is common; the number of blocks follows the number of shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as wd

#: Blocks of the hash range (as a power of two) at least.
BLOCK_BITS = 6


def block_bits(shards: int) -> int:
    return max(BLOCK_BITS, (shards // 8).bit_length())


LISTS = "shard long, block long, hashes binary, counts binary, size long"


def lists(shard: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """The sorted hashes of a shard with their counts, one row for each block (the highest ``bits`` of the hash)."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order].astype(np.int64)
    block = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(block)]
    rows = [(shard, int(block[a]), wd.packed(hashes[a:z]), wd.packed(counts[a:z]), z - a) for a, z in zip(cut.tolist(), ends, strict=False)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["shard", "block", "hashes", "counts", "size"])


def sieve(rows_of_lists: DataFrame, least: int) -> DataFrame:
    """Per list: the places of the hashes whose counts sum to ``least`` over all lists, the sums, and whether it is the first list
    that has the hash."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("owner", pa.binary()), ("size", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["size"].to_pylist()
        hashes = np.concatenate([wd.unpacked(x.as_py(), n, "<u8") for x, n in zip(rows["hashes"], sizes, strict=True)])
        counts = np.concatenate([wd.unpacked(x.as_py(), n, "<i8") for x, n in zip(rows["counts"], sizes, strict=True)])
        _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, own, counts)
        owner = np.zeros(len(hashes), np.int32)
        owner[first] = 1
        out, at = [], 0
        for shard, block, n in zip(rows["shard"].to_pylist(), rows["block"].to_pylist(), sizes, strict=True):
            total = sums[own[at : at + n]]
            places = np.flatnonzero(total >= least).astype(np.int32)
            if len(places):
                out.append((shard, block, wd.packed(places), wd.packed(total[places]), wd.packed(owner[at : at + n][places]), len(places)))
            at += n
        return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*out, strict=True)) or [()] * 6, schema, strict=True)], schema=schema)

    return rows_of_lists.groupBy("block").applyInArrow(run, "shard long, block long, places binary, sums binary, owner binary, size long")


def left(hashes: np.ndarray, kept: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (in ``hashes``) of what the sieve left of a shard, the sums, and whether the shard is the first that has it."""
    order = np.argsort(hashes)
    block = (hashes[order] >> np.uint64(64 - bits)).astype(np.int64)
    own, sums, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for r in kept.to_pylist():
        own.append(np.searchsorted(block, r["block"]) + wd.unpacked(r["places"], r["size"]))
        sums.append(wd.unpacked(r["sums"], r["size"], "<i8"))
        owner.append(wd.unpacked(r["owner"], r["size"]))
    return order[np.concatenate(own)], np.concatenate(sums), np.concatenate(owner) > 0
