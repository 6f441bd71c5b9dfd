"""Streaming operators.

The batch operators read whole histories; these are their incremental forms:
state lives in the streaming state store (checkpointed under the query's
checkpoint location), late rows are bounded by watermarks, and every sink is
either append-only or idempotent per micro-batch, so a restarted query (or a
lost executor) neither loses nor duplicates output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import broadcast_if_small

# Collection tiers as trigger intervals.
TRIGGER_TIERS = {"fast": "5 seconds", "minute": "60 seconds", "ten_minutes": "600 seconds", "hour": "3600 seconds"}


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Source of new files under ``path`` (stored offsets = the checkpoint)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _event_time(df: DataFrame, time: str) -> tuple[DataFrame, bool]:
    """Watermarks need TIMESTAMP; wall-clock (NTZ) event times are read as session-zone timestamps."""
    ntz = dict(df.dtypes)[time] == "timestamp_ntz"
    return (df.withColumn(time, F.col(time).cast("timestamp")) if ntz else df), ntz


def dedup_stream(df: DataFrame, keys: Sequence[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """Exactly-once append of snapshots/events: duplicates of a key within the
    watermark are dropped; state older than the watermark is evicted (Z1)."""
    d, ntz = _event_time(df, time)
    out = d.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))
    return out.withColumn(time, F.col(time).cast("timestamp_ntz")) if ntz else out


def trend_stream(df: DataFrame, keys: Sequence[str], time: str, value: str, minutes: int,
                 watermark: str = "10 minutes") -> DataFrame:
    """Tumbling n-minute trend windows, emitted once closed (append mode)."""
    d, ntz = _event_time(df, time)
    w = d.withWatermark(time, watermark)
    g = (w.groupBy(*keys, F.window(time, f"{minutes} minutes").alias("_w"))
         .agg(F.avg(value).alias("value_avg"), F.min(value).alias("value_min"),
              F.max(value).alias("value_max"), F.sum(value).alias("value_sum"), F.count(value).alias("value_count")))
    start = F.col("_w.start").cast("timestamp_ntz") if ntz else F.col("_w.start")
    return g.select(*keys, start.alias(time), "value_avg", "value_min", "value_max", "value_sum",
                    "value_count", F.lit(minutes).alias("interval_minutes"))


class CounterDeltas(StatefulProcessor):
    """Counter deltas of one (instance, type) over a stream, a row at a time.

    State: the time of the last snapshot, and a map from (snapshot time, key) to the values. A micro-batch's rows are put into the map one
    Arrow batch after the other, then its snapshots are compared in time order and all but the last are removed, so the
    process holds one Arrow batch and the distinct snapshot times of the micro-batch, however many keys there are.
    An (instance, type) that falls silent keeps its last snapshot.
    """

    BATCH = 10_000

    def __init__(self, header_keys, names, time, cols, rest, kinds) -> None:
        self.header_keys, self.names, self.time, self.cols, self.rest = header_keys, names, time, cols, rest
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")
        key = ", ".join(["t bigint", *[f"k{i} {self.kinds[n]}" for i, n in enumerate(self.names)]])
        held = ", ".join([*[f"v{i} bigint" for i in range(len(self.cols))], *[f"r{i} {self.kinds[n]}" for i, n in enumerate(self.rest)]])
        self.rows = handle.getMapState("rows", key, held)

    @staticmethod
    def _plain(v):
        return None if pd.isna(v) else v.item() if hasattr(v, "item") else v

    def _values(self, column: pd.Series, kind: str) -> list:
        """Plain values; integers stay integers where a NULL made their column one of floats."""
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        return [None if pd.isna(v) else int(v) if whole else self._plain(v) for v in column]

    def _place(self, place) -> tuple:
        """A key of the map as it was put there: the iterator gives NaN for NULL."""
        return (int(place[0]), *map(self._plain, place[1:]))

    def _frame(self, key, out) -> pd.DataFrame:
        names = [*self.names, self.time, *self.cols, *self.rest, *[f"{c}_delta" for c in self.cols], "delta_seconds"]
        pdf = pd.DataFrame(out, columns=names)
        pdf[self.time] = pd.to_datetime(pdf[self.time], unit="us").astype("datetime64[us]")
        for c in (*self.cols, "delta_seconds"):
            pdf[c] = pdf[c].astype("Int64")
        for i, k in enumerate(self.header_keys):
            pdf.insert(i, k, key[i])
        return pdf

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        times: set[int] = set()
        for pdf in rows:
            stamps = pdf[self.time].astype("datetime64[us]").astype("int64").tolist()
            parts = [self._values(pdf[c], self.kinds[c]) for c in (*self.names, *self.cols, *self.rest)]
            for t, *values in zip(stamps, *parts, strict=True):
                if last is not None and t <= last:  # late or repeated snapshots are accounted for
                    continue
                place = (t, *values[: len(self.names)])
                if not (t in times and self.rows.containsKey(place)):
                    self.rows.updateValue(place, tuple(values[len(self.names) :]))
                times.add(t)
        if not times:
            return
        ordered = sorted(times)
        before = dict(zip(ordered, [last, *ordered[:-1]], strict=True))
        out, n = [], len(self.cols)
        for place, held in self.rows.iterator():
            place = self._place(place)
            held = (*(None if pd.isna(v) else int(v) for v in held[: len(self.cols)]), *map(self._plain, held[len(self.cols) :]))
            t = place[0]
            if t == last:
                continue
            earlier = (before[t], *place[1:])
            old = self.rows.getValue(earlier) if before[t] is not None and self.rows.containsKey(earlier) else None
            old = None if old is None else tuple(map(self._plain, old))
            grown = [0 if old is None or a is None or b is None else max(a - b, 0) for a, b in zip(held[:n], old[:n] if old else held[:n], strict=True)]
            out.append((*place[1:], t, *held, *grown, None if old is None else (t - before[t]) // 1_000_000))
            if len(out) == self.BATCH:
                yield self._frame(key, out)
                out = []
        if out:
            yield self._frame(key, out)
        while gone := list(islice((p for p in map(self._place, self.rows.keys()) if p[0] != ordered[-1]), self.BATCH)):
            for place in gone:
                self.rows.removeKey(place)
        self.last.update((ordered[-1],))

    def close(self) -> None:
        pass


def stateful_counter_delta(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                           header_keys: Sequence[str] = ("sql_instance", "snapshot_type_id")) -> DataFrame:
    """Reset-safe counter delta over a stream (Z2, M1, M1n): against the previous *snapshot* of the (instance, type),
    as ``deltas.counter_delta`` does; a key that is absent there has delta 0 and no seconds.

    State is kept by row (:class:`CounterDeltas`), so it needs the RocksDB state store. Output: the input
    columns plus ``<c>_delta`` and ``delta_seconds``. A row of a snapshot at or before the last one is late and dropped.
    """
    names = [k for k in keys if k not in header_keys]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rest = [c for c in df.columns if c not in {*header_keys, *names, time, *cols}]
    rows = df.select(*header_keys, *names, time, *cols, *rest)
    fields = ", ".join(f"{c} {kinds[c]}" for c in rows.columns)
    out_schema = fields + ", " + ", ".join(f"{c}_delta bigint" for c in cols) + ", delta_seconds bigint"
    processor = CounterDeltas(list(header_keys), names, time, list(cols), rest, kinds)
    return rows.groupBy(*header_keys).transformWithStateInPandas(processor, out_schema, "append", "None")


def _alert_fn():
    from types import SimpleNamespace

    from ..operators.alerts import NEW, NONE, RECOVERY, REPEAT, _decide

    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev_status, prev_value, sends = None, None, {"sent": [], "last": None}
        if state.exists:
            prev_status, prev_value, sent, last = state.get
            prev_value = None if prev_value is None or pd.isna(prev_value) else prev_value
            sends = {"sent": [pd.Timestamp(x) for x in (sent if sent is not None else [])],
                     "last": None if last is None or pd.isna(last) else pd.Timestamp(last)}
        out = []
        for r in pd.concat(list(pdfs)).sort_values("snapshot_time", kind="stable").itertuples(index=False):
            status, value = r.check_status, None if pd.isna(r.check_value) else r.check_value
            before = prev_status if prev_status is not None else "OK"
            changed = prev_value is None or (value is not None and value != prev_value)
            if status != "OK" and before == "OK":
                typ = NEW
            elif status == "OK" and before != "OK" and r.action_recovery:
                typ = RECOVERY
            elif status != "OK" and before != "OK" and changed and r.action_every_failure:
                typ = REPEAT
            else:
                typ = NONE
            repeat = status != "OK" and prev_status == status and not pd.isna(r.action_repeat_period_minutes)
            if typ != NONE or repeat:  # the rows that the batch form replays, decided by the same function
                step = SimpleNamespace(**{**r._asdict(), "action_type": typ, "repeat_candidate": repeat})
                typ, sent, reason, _ = _decide(step, sends)
                out.append((key[0], int(key[1]), int(key[2]), r.snapshot_time, typ, sent, reason))
            prev_status, prev_value = status, value
        state.update((prev_status, prev_value, sends["sent"], sends["last"]))
        if out:
            yield pd.DataFrame(out, columns=["sql_instance", "check_id", "action_id", "snapshot_time",
                                             "action_type", "sent", "suppressed_reason"])
    return fn


def alert_stream(checks: DataFrame, actions: DataFrame) -> DataFrame:
    """Alert state machine over a stream of check results.

    ``checks``: sql_instance, check_id, snapshot_time, check_status,
    check_value, is_flapping. ``actions`` is static configuration joined in
    (stream-static join). State per (instance, check, action): previous
    status and value, and the send times of the last hour.
    """
    j = checks.join(broadcast_if_small(actions), "check_id")
    j = j.select("sql_instance", "check_id", "action_id", "snapshot_time", "check_status", "check_value",
                 "is_flapping", "action_every_failure", "action_recovery", "action_repeat_period_minutes",
                 "action_hourly_limit")
    out = ("sql_instance string, check_id int, action_id int, snapshot_time timestamp_ntz, action_type string, "
           "sent boolean, suppressed_reason string")
    st = "prev_status string, prev_value double, sent array<timestamp_ntz>, last_sent timestamp_ntz"
    return j.groupBy("sql_instance", "check_id", "action_id").applyInPandasWithState(
        _alert_fn(), out, st, "append", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, tier: str | None = None,
          available_now: bool = False, output_mode: str = "append", name: str | None = None, **options):
    """Start a streaming query on a collection tier (Z6), or drain what is available.

    ``sink`` is a format name or a ``foreachBatch`` function (idempotent per
    batch id, e.g. overwrite of a batch-id partition).
    """
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    if callable(sink):
        w = w.foreachBatch(sink)
    else:
        w = w.format(sink).options(**options)
    if available_now:
        w = w.trigger(availableNow=True)
    elif tier:
        w = w.trigger(processingTime=TRIGGER_TIERS[tier])
    return w.start()


def refresh_then_load(dim_loader: Callable[[DataFrame, int], None], fact_loader: Callable[[DataFrame, int], None]):
    """foreachBatch body that refreshes dimensions before facts in each batch."""
    def body(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            dim_loader(batch, batch_id)
            fact_loader(batch, batch_id)
        finally:
            batch.unpersist()
    return body


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def incremental_delta_batches(samples_path: str, deltas_path: str, keys: Sequence[str], time: str,
                              cols: Sequence[str], header_keys: Sequence[str] = ("sql_instance", "snapshot_type_id")):
    """``foreachBatch`` body for counter deltas over micro-batches of samples.

    Each batch is joined only to the boundary snapshot of the samples stored by
    earlier batches (``counter_delta_incremental``), then both the batch's
    samples and its deltas are written to the ``batch_id`` partition of their
    tables with dynamic partition overwrite. A batch replayed after a failure
    reads only earlier batches and rewrites its own partitions: exactly-once
    output without keeping the history in the state store.
    """
    from ..operators.deltas import counter_delta_incremental

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, samples_path):  # any other failure to read is an error
            stored = spark.read.parquet(samples_path).filter(F.col("batch_id") < batch_id).drop("batch_id")
        else:
            stored = spark.createDataFrame([], batch.schema)
        batch.persist()  # read for both writes
        try:
            deltas = counter_delta_incremental(batch, stored.select(*batch.columns), keys, time, cols,
                                               header_keys=header_keys)
            for df, path in ((batch, samples_path), (deltas, deltas_path)):
                (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                   .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
        finally:
            batch.unpersist()
    return body
