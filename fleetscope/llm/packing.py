"""Best-fit packing of documents into token sequences by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens (a written table). The histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver, which solves the program: as few
sequences as possible, each filled by a configuration (so many pieces of this length, so many of that), so that every
length is covered. Multiplicative weights hold a price for each length; a knapsack dynamic program finds, for each
length that still lacks cover, the configuration of highest price that has it; lengths covered too often get cheaper.
The fractional solution is rounded down with carry, and what is left is filled by best fit on the histogram.

The plan goes back to the executors as intervals: the pieces of one length are numbered, and an interval of numbers
belongs to the copies of one configuration. The plan is bounded by the solver's configurations (``ROUNDS`` x
``capacity``) and not by the corpus. Pieces of one length are numbered in hash buckets of bounded size, so a length
that a third of all documents share is no hot key.

Defined cases: null text is empty text, one token (the end id); a document longer than a sequence is cut and its last
piece may be shorter; repeated rows are packed one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import encoded, ids_crc32, vocabulary_path

END_ID = 1
CAPACITY = 4096
ROUNDS = 24
#: How fast the price of a length falls with its cover.
RATE = 0.7
#: Pieces numbered in one window.
BUCKET_PIECES = 200_000


def best_fill(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room 0..capacity the highest total price and the last length taken (0: none)."""
    lengths = np.flatnonzero(prices > 0)
    worth = prices[lengths]
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        if k:
            total = value[room - lengths[:k]] + worth[:k]
            best = int(total.argmax())
            if total[best] > value[room - 1]:
                value[room], last[room] = total[best], lengths[best]
                continue
        value[room], last[room] = value[room - 1], -1  # leave one token free
    return value, last


def _taken(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and last[room]:
        if last[room] > 0:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations (lengths in descending order) and how often each is used; covers the histogram exactly."""
    need = np.zeros(capacity + 1)
    for length, n in histogram.items():
        need[length] = n
    lengths = np.flatnonzero(need)[::-1]
    if not len(lengths):
        return []
    price = np.where(need > 0, np.arange(capacity + 1) / capacity, 0.0)
    cover = np.zeros(capacity + 1)
    use: dict[bytes, float] = {}  # by the configuration's lengths as 32-bit integers: compact
    for t in range(1, rounds + 1):
        _, last = best_fill(price, capacity)
        due = need * t / rounds
        for length in lengths:
            lack = due[length] - cover[length]
            if lack <= 1e-9:
                continue
            chosen = np.array(sorted([int(length), *_taken(last, capacity - int(length))], reverse=True), np.int32)
            step = lack / np.count_nonzero(chosen == length)
            key = chosen.tobytes()
            use[key] = use.get(key, 0.0) + step
            np.add.at(cover, chosen, step)
        over = np.divide(cover, due, out=np.ones_like(cover), where=due > 0) - 1
        price *= np.exp(-RATE * np.clip(over, 0, 3))
        price /= price.max()
    left = need.astype(np.int64)
    plan: list[tuple[np.ndarray, int]] = []
    carry = 0.0

    def order(key: bytes) -> tuple[int, int, bytes]:
        chosen = np.frombuffer(key, np.int32)
        return -int(chosen[0]), -int(chosen.sum()), key

    for key in sorted(use, key=order):
        chosen, x = np.frombuffer(key, np.int32), use[key]
        kinds, each = np.unique(chosen, return_counts=True)
        times = min(int(x + carry), int((left[kinds] // each).min()))
        carry = min(x + carry - times, 1.0)
        if times and chosen.sum() >= capacity - capacity // 512:  # the rest is better off by best fit
            left[kinds] -= each * times
            plan.append((chosen, times))
    while left.any():
        room, chosen, spare = capacity, [], left.copy()
        while (fit := np.flatnonzero(spare[: room + 1])).size:
            chosen.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            room -= int(fit[-1])
        kinds, each = np.unique(np.array(chosen), return_counts=True)
        times = int((left[kinds] // each).min())
        left[kinds] -= each * times
        plan.append((np.array(chosen, np.int32), times))
    return plan


def _intervals(plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For each length in each configuration, by (length, first number): what a piece's number means."""
    rows, taken, sequence = [], {}, 0
    for chosen, times in plan:
        kinds, first, each = np.unique(-chosen, return_index=True, return_counts=True)
        ends = np.cumsum(chosen)
        for k, f, m in zip((-kinds).tolist(), first.tolist(), each.tolist(), strict=True):
            at = taken.get(k, 0)
            rows.append((k, at, m, sequence, int(ends[f]) - k))
            taken[k] = at + m * times
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols.T, strict=True))


_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, capacity: int, with_ids: bool, kind: pa.DataType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, i, at, part)
                for doc, ids in encoded(batch, vocabulary, END_ID)
                for i, at in enumerate(range(0, len(ids), capacity))
                for part in [ids[at : at + capacity]]
            ]
            cols = [
                pa.array([r[0] for r in rows], kind),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([len(r[3]) for r in rows], pa.int64()),
                pa.array([ids_crc32(r[3]) for r in rows], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return cut


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    name = rows.schema["_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    schema = _PIECES.format(id=name) + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_cut(vocabulary or vocabulary_path(), capacity, with_ids, kind), schema)


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans = _intervals(solve(histogram, capacity))
    sent = spark.sparkContext.broadcast(spans)
    buckets = sum(histogram.values()) // BUCKET_PIECES + 1
    rows = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("_r", F.row_number().over(within) - 1)
        .join(counts, ["length", "_b"])
        .withColumn("_number", F.col("_r") + F.col("_before"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):  # type: ignore[no-untyped-def]
        import pandas as pd

        s = sent.value
        keys = s["length"] << 44 | s["first"]
        at = np.searchsorted(keys, length.to_numpy() << 44 | number.to_numpy(), side="right") - 1
        k = number.to_numpy() - s["first"][at]
        return pd.DataFrame(
            {"sequence_id": s["sequence"][at] + k // s["each"][at], "offset": s["offset"][at] + k % s["each"][at] * s["length"][at]}
        )

    out = ranked.withColumn("_p", place("length", "_number"))
    return out.select(*cut.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(written(pieces(docs, id_col, text_col, vocabulary, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids, offsets."""
    cut = written(pieces(docs, id_col, text_col, vocabulary, capacity, with_ids=True), "pieces")
    part = F.struct("offset", "doc_id", "ids")
    parts = placed(cut, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    return parts.select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("offsets")
    )
