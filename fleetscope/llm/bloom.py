"""Bloom filters built by Spark tasks: each task emits the cells it hits, a shuffle by block merges them.

A filter of ``least=1`` marks every cell that was hit, one of ``least=2`` the cells hit twice or more. Only marked bits
reach the driver, ``MAX_FILTER_BITS`` / 8 bytes at most (32 MB), and are broadcast. With more rows than that the filter
gives more false alarms and no wrong denial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
BLOCK_BITS = 1 << 16

_CELLS = "block int, once binary, twice binary"
_BLOCKS = "block int, bits binary"


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each 64-bit hash: an array of len(hashes) x HASHES (double hashing)."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:, None] + k[None, :] * step[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


def _hit_cells(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells, n = np.unique(_cells(b.column(0).to_numpy(zero_copy_only=False), bits).ravel(), return_counts=True)
            block, at = cells // BLOCK_BITS, (cells % BLOCK_BITS).astype("<u2")
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], len(block)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[starts].astype(np.int32)),
                    pa.array([at[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([at[s:e][n[s:e] > 1].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["block", "once", "twice"],
            )

    return emit


def _merge_blocks(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by block; holds the cells of one block at a time."""
        block, once, twice = None, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)

        def out() -> pa.RecordBatch:
            bits = np.packbits(once if least == 1 else twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

        for b in batches:
            for k, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block, once[:], twice[:] = k, False, False
                cells = np.frombuffer(one, "<u2")
                twice[cells[once[cells]]] = True
                twice[np.frombuffer(two, "<u2")] = True
                once[cells] = True
        if block is not None:
            yield out()

    return merge


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all cells of each 64-bit hash are marked in ``bits`` (packed, 8 cells a byte)."""
    cells = _cells(hashes, 8 * len(bits))
    return ((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=1)


class Filter:
    """A broadcast filter; ``asked(column)`` tells whether all cells of a bigint hash are marked. Tasks that run Python
    anyway call :func:`marked` on ``sent.value`` instead."""

    def __init__(self, hashes: DataFrame, rows: int, least: int) -> None:
        bits = BLOCK_BITS
        while bits < min(rows * BITS_PER_ROW, MAX_FILTER_BITS):
            bits *= 2
        blocks = (
            hashes.mapInArrow(_hit_cells(bits), _CELLS).repartition("block").sortWithinPartitions("block").mapInArrow(_merge_blocks(least), _BLOCKS)
        )
        out = np.zeros(bits // 8, np.uint8)
        for r in blocks.collect():  # MAX_FILTER_BITS / 8 bytes in all
            out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
        self.sent = sent = hashes.sparkSession.sparkContext.broadcast(out)

        @F.pandas_udf("boolean")
        def ask(h):  # type: ignore[no-untyped-def]
            import pandas as pd

            return pd.Series(marked(sent.value, h.to_numpy()))

        self.asked = ask

    def close(self) -> None:
        """Free the broadcast, when what was asked is in a written table."""
        self.sent.destroy()
