"""Token ids in Arrow files of equal-length sequences.

The documents are range-partitioned and sorted by id; each task tokenises its range and writes one Arrow IPC file:
record batches of ``BATCH_ROWS`` rows, each row a fixed-size list of ``length`` ids and a fixed-size list of mask bits
(false on the padding of the last row). All batches but the last have the same number of rows, so any sequence is
found by division, without reading what lies before it, and a memory-mapped file gives it without a copy. Beside it
lies an index file (document id, first token in the file, number of tokens).

File names hold a fresh id for every attempt of a task, and the manifest (one row a file, a written table) names the
files of the attempts that counted: files of lost or doubled attempts are never read.

Defined cases: null text is empty text, which has the end id only; equal document ids keep one entry a row, next to
each other; null ids come first; an empty table gives no files and an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_folder, written
from .tokens import encoded, encoder, ids_crc32, vocabulary_path

END_ID = 1
LENGTH = 2048
BATCH_ROWS = 128

_MANIFEST = "shard int, ids_file string, index_file string, n_docs long, n_tokens long"


def _open_fs(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


class TokenWriter:
    """Writes ids into one file, in 16 bits or, with ``wide``, in 32; an id that does not fit is an error."""

    def __init__(self, sink, length: int = LENGTH, wide: bool = False) -> None:
        self.length, self.held, self.held_n = length, [], 0
        self.kind = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema(
            [("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))],
            metadata={"length": str(length), "batch_rows": str(BATCH_ROWS)},
        )
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.length * BATCH_ROWS:
            flat, whole = np.concatenate(self.held), self.length * BATCH_ROWS
            for at in range(0, len(flat) - whole + 1, whole):
                self._write(flat[at : at + whole])
            self.held = [flat[len(flat) - len(flat) % whole :]]
            self.held_n = len(self.held[0])

    def _write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.length)
        if len(flat) and int(flat.max()) > np.iinfo(self.kind.to_pandas_dtype()).max:
            raise OverflowError(f"token id {int(flat.max())} does not fit {self.kind}")
        ids, mask = np.zeros(rows * self.length, self.kind.to_pandas_dtype()), np.zeros(rows * self.length, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, True
        lists = pa.FixedSizeListArray.from_arrays
        self.file.write_batch(
            pa.record_batch([lists(pa.array(ids), type=self.schema.field(0).type), lists(pa.array(mask), type=self.schema.field(1).type)], schema=self.schema)
        )

    def close(self) -> None:
        if self.held_n:
            self._write(np.concatenate(self.held))
        self.file.close()


class TokenReader:
    """Random access to the sequences of a file; ids are views of the mapped file."""

    def __init__(self, source) -> None:
        self.file = pa.ipc.open_file(source)
        meta = self.file.schema.metadata
        self.length, self.batch_rows = int(meta[b"length"]), int(meta[b"batch_rows"])
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _flat(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.held = (k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
        return self.held[1]

    def sequence(self, row: int) -> np.ndarray:
        """The ids of one row (padding included), without a copy."""
        at = row % self.batch_rows * self.length
        return self._flat(row // self.batch_rows)[at : at + self.length]

    def mask(self, row: int) -> np.ndarray:
        batch = self.file.get_batch(row // self.batch_rows)
        return batch.column(1).slice(row % self.batch_rows, 1).flatten().to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """The ``n`` ids from token ``start`` of the file."""
        whole, out = self.length * self.batch_rows, []
        while n > 0:
            k, at = divmod(start, whole)
            part = self._flat(k)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def _write_shard(folder: str, vocabulary: str, length: int, id_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{shard:06d}-{attempt}.{kind}.arrow" for kind in ("ids", "index")]
        entry = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        sink, docs, total, index = None, 0, 0, None
        for batch in batches:
            ids, starts, counts = [], [], []
            for doc, tokens in encoded(batch, vocabulary, END_ID):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{names[0]}")
                    out = TokenWriter(sink, length, encoder(vocabulary).largest_id >= 1 << 16)
                    index_sink = fs.open_output_stream(f"{root}/{names[1]}")
                    index = pa.ipc.new_file(index_sink, entry)
                out.add(tokens)
                ids.append(doc)
                starts.append(total)
                counts.append(len(tokens))
                total += len(tokens)
            if ids:
                index.write_batch(pa.record_batch([pa.array(ids, id_type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=entry))
                docs += len(ids)
        if sink is not None:
            out.close()
            sink.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "ids_file": names[0], "index_file": names[1], "n_docs": docs, "n_tokens": total}],
                schema=pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("index_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return write


def write_tokens(
    docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, length: int = LENGTH,
) -> tuple[str, DataFrame]:
    """Write the files; returns their folder and the manifest (shard, ids_file, index_file, n_docs, n_tokens,
    first_token: the tokens of all files before it), in ascending order of the ids."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema["_id"].dataType.simpleString()]
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id")
    shards = written(ordered.mapInArrow(_write_shard(folder, vocabulary or vocabulary_path(), length, kind), _MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return folder, shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_shard(folder: str, id_type: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        local = type(fs).__name__ == "LocalFileSystem"
        source = (lambda name: pa.memory_map(f"{root}/{name}")) if local else (lambda name: fs.open_input_file(f"{root}/{name}"))
        for batch in batches:
            for f in batch.to_pylist():
                ids, index = TokenReader(source(f["ids_file"])), pa.ipc.open_file(source(f["index_file"]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = [ids_crc32(ids.span(s, n)) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(starts + f["first_token"]), part.column(2), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_documents(folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    n = max(1, manifest.count())  # a task for each file: the manifest itself is small, what it names is not
    files = manifest.select("shard", "ids_file", "index_file", "first_token").repartitionByRange(n, "shard")
    return files.select("ids_file", "index_file", "first_token").mapInArrow(
        _read_shard(folder, kind), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )
