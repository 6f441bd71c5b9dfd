"""Event source with stored offsets, as a Python data source.

A store of events is a folder with one directory of Parquet files per collection session::

    <path>/session_name=<name>/*.parquet     events of the session (event_time and any other columns)
    <path>/_sessions.json                    {"<name>": <execution count>}: how often the session fired so far

The offset of a stream is, per session, (execution count, time of the last event read). A session is polled when its execution
count moved past the stored one and its last event is ``minIntervalSeconds`` old at least (or it was never read); the new end is
the newest event time in the footers of its files. Events at or before the stored time count as late and are not read, so a
restarted query neither repeats nor skips events, and a session that did not fire costs one look at the small session file. Files whose footer ends
before the offset are not opened for reading; each other file is one task, read in Arrow batches.

Options: ``path``; ``minIntervalSeconds`` (0); ``now`` (ISO time; the clock if unset); ``objectName`` (only events of that object);
``since`` (batch reads: JSON, session to last event time in ISO form). The folder is opened with ``pyarrow.fs`` by its URI.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "fleet_events"
SESSIONS_FILE = "_sessions.json"
_EPOCH = dt.datetime(1970, 1, 1)


def _micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def _time(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@dataclass
class FilePart(InputPartition):
    """One file of a session; events after ``after`` up to ``upto`` (microseconds; None: no bound)."""

    file: str
    session: str
    after: int | None
    upto: int | None


class _Store:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        if "path" not in options:
            raise ValueError("the event source needs a path")
        self.path, self.schema = options["path"], schema
        self.min_interval = int(options.get("minintervalseconds", options.get("minIntervalSeconds", "0")))
        self.now = options.get("now")
        self.object_name = options.get("objectname", options.get("objectName"))

    def files(self):
        """The file system and the folder's path in it."""
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def counts(self) -> dict[str, int]:
        system, base = self.files()
        from pyarrow import fs

        where = f"{base.rstrip('/')}/{SESSIONS_FILE}"
        if system.get_file_info(where).type == fs.FileType.NotFound:
            return {}
        with system.open_input_stream(where) as f:
            return {str(k): int(v) for k, v in json.loads(f.read()).items()}

    def spans(self, session: str) -> list[tuple[str, int, int]]:
        """(file, first and last event time) of a session's files with events, from their footers."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = self.files()
        folder = fs.FileSelector(f"{base.rstrip('/')}/session_name={session}", allow_not_found=True)
        out = []
        for info in sorted(system.get_file_info(folder), key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            place = meta.schema.names.index("event_time")
            stats = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
            known = [s for s in stats if s is not None and s.has_min_max]
            if not stats:
                continue
            if len(known) < len(stats):  # no statistics: the file must be read
                out.append((info.path, None, None))
            else:
                out.append((info.path, min(_micros(s.min.replace(tzinfo=None)) for s in known), max(_micros(s.max.replace(tzinfo=None)) for s in known)))
        return out

    def read(self, part: FilePart | None) -> Iterator:
        if part is None:  # how Spark asks for the rows of no partitions
            return
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = self.files()
        target = to_arrow_schema(self.schema)
        own = [n for n in self.schema.names if n != "session_name"]
        with system.open_input_file(part.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=sorted({*own, "event_time", *(["object_name"] if self.object_name else [])})):
                rows = pa.Table.from_batches([batch])
                time = rows["event_time"].cast(pa.timestamp("us")).cast(pa.int64())
                keep = pc.is_valid(time)
                if part.after is not None:
                    keep = pc.and_(keep, pc.greater(time, part.after))
                if part.upto is not None:
                    keep = pc.and_(keep, pc.less_equal(time, part.upto))
                if self.object_name:
                    keep = pc.and_(keep, pc.equal(rows["object_name"], self.object_name))
                rows = rows.filter(pc.fill_null(keep, False))
                columns = [pa.array([part.session] * rows.num_rows, pa.string()) if n == "session_name" else rows[n].cast(target.field(n).type)
                           for n in self.schema.names]
                yield from pa.table(columns, schema=target).to_batches()


class EventReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.store = _Store(options, schema)
        self.since = {k: _micros(_time(v)) for k, v in json.loads(options.get("since", "{}")).items()}

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePart(file, session, self.since.get(session), None)
                for session in sorted(self.store.counts())
                for file, _, last in self.store.spans(session) if session not in self.since or last is None or last > self.since[session]]

    def read(self, partition: FilePart) -> Iterator:
        return self.store.read(partition)


class EventStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.store = _Store(options, schema)
        self.reached: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Offsets move only for sessions that fired since and whose interval has passed."""
        now = _micros(_time(self.store.now) if self.store.now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        for session, count in self.store.counts().items():
            seen, last = self.reached.get(session, (0, None))
            if count <= seen or (last is not None and now - last < self.store.min_interval * 1_000_000):
                continue
            ends = [x for _, _, x in self.store.spans(session) if x is not None]
            newest = max(ends, default=last)
            if newest is not None and (last is None or newest > last):
                self.reached[session] = [count, newest]
        return {k: list(v) for k, v in self.reached.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # a restarted query plans from its stored offsets before it asks for new ones
        for session, at in (*start.items(), *end.items()):
            if at[1] is not None and at[1] > self.reached.get(session, (0, -1 << 62))[1]:
                self.reached[session] = list(at)
        parts = []
        for session, (_, upto) in sorted(end.items()):
            after = start[session][1] if session in start else None
            if after == upto:
                continue
            parts += [FilePart(file, session, after, upto) for file, first, last in self.store.spans(session)
                      if last is None or ((after is None or last > after) and first <= upto)]
        return parts

    def read(self, partition: FilePart) -> Iterator:
        return self.store.read(partition)


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "session_name string, event_id bigint, event_time timestamp_ntz, object_name string, event_data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventStreamReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format ``fleet_events`` known to the session."""
    spark.dataSource.register(EventSource)


def write_events(events: DataFrame, path: str, counts: dict[str, int], mode: str = "append") -> None:
    """Append events (``session_name`` and the columns of the source) to a store, and then the execution counts of its
    sessions, so a reader that sees a count finds its events."""
    spark = events.sparkSession
    events.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).write.mode(mode).partitionBy("session_name").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path, SESSIONS_FILE)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(counts).encode()))
    finally:
        out.close()


def event_stream(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """The stream of new events of a store; offsets are kept in the checkpoint of the query that reads it."""
    register(spark)
    r = spark.readStream.format(NAME).option("path", path).options(**options)
    return (r.schema(schema) if schema else r).load()


def stored_events(spark: SparkSession, path: str, since: dict[str, str] | None = None, schema: str | None = None, **options) -> DataFrame:
    """All events of a store after ``since`` (session to the time of the last event read) (S3)."""
    register(spark)
    r = spark.read.format(NAME).option("path", path).option("since", json.dumps(since or {})).options(**options)
    return (r.schema(schema) if schema else r).load()
