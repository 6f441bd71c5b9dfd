"""The event source: offsets, poll interval, restart; counter deltas by row over random micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.deltas import counter_delta
from fleetscope.sources import event_source as es
from fleetscope.streaming import operators as so

SCHEMA = "session_name string, event_id bigint, event_time timestamp_ntz, object_name string, event_data string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def events(spark, rows):
    return spark.createDataFrame([(s, i, at(m), "rpc" if i % 2 else "batch", f"<e n='{i}'/>") for s, i, m in rows], SCHEMA)


def test_stream_restarts_from_its_offsets(spark, tmp_path):
    path, sink = str(tmp_path / "store"), str(tmp_path / "sink")

    def run(now, **options):
        q = so.start(es.event_stream(spark, path, now=now.isoformat(), **options), "parquet", str(tmp_path / "ck"), available_now=True, path=sink)
        q.awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(sink).collect())

    es.write_events(events(spark, [("waits", 1, 0), ("waits", 2, 5), ("health", 3, 2)]), path, {"waits": 2, "health": 1})
    assert run(at(10)) == [1, 2, 3]
    # an event behind the offset is late; a session whose count has not moved is not polled
    es.write_events(events(spark, [("waits", 4, 3), ("waits", 5, 7), ("health", 6, 9)]), path, {"waits": 4, "health": 1})
    assert run(at(10)) == [1, 2, 3, 5]
    es.write_events(events(spark, [("waits", 7, 12)]), path, {"waits": 5, "health": 2})
    assert run(at(13), minIntervalSeconds="3600") == [1, 2, 3, 5]  # both sessions were read less than an hour ago
    assert run(at(100), minIntervalSeconds="3600") == [1, 2, 3, 5, 6, 7]
    assert run(at(200)) == [1, 2, 3, 5, 6, 7]


def test_batch_reader_prunes_files(spark, tmp_path):
    path = str(tmp_path / "store")
    es.write_events(events(spark, [("waits", 1, 0), ("waits", 2, 5)]), path, {"waits": 2})
    es.write_events(events(spark, [("waits", 3, 6), ("health", 4, 9)]), path, {"waits": 3, "health": 1})
    got = lambda **o: sorted((r.session_name, r.event_id) for r in es.stored_events(spark, path, **o).collect())
    assert got() == [("health", 4), ("waits", 1), ("waits", 2), ("waits", 3)]
    assert got(since={"waits": at(5).isoformat()}) == [("health", 4), ("waits", 3)]
    assert got(objectName="rpc") == [("waits", 1), ("waits", 3)]
    reader = es.EventReader({"path": path, "since": '{"waits": "2024-01-01T00:05:00"}'}, spark.read.schema(SCHEMA).parquet(path).schema)
    assert all(p.after is None or p.session == "waits" for p in reader.partitions()) and len(reader.partitions()) == 2
    assert es.stored_events(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        es.EventReader({}, None)


@pytest.mark.parametrize("seed", [3])
def test_deltas_by_row_equal_the_batch_form_over_random_micro_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    schema = "sql_instance string, name string, snapshot_type_id int, snapshot_time timestamp_ntz, v bigint, note string"
    keys = ["sql_instance", "name", "snapshot_type_id"]
    rows = []
    for inst in ("a", "b", "hot"):
        value = 0
        for m in range(0, 60, rnd.choice([5, 10])):
            for k in range(12 if inst == "hot" else 3):
                if rnd.random() < 0.8:  # most keys miss some snapshots
                    value = 0 if rnd.random() < 0.1 else value + rnd.randrange(50)
                    rows.append((inst, f"k{k}" if k else None, 1, at(m), None if rnd.random() < 0.05 else value, f"n{m}"))
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    cuts = sorted(rnd.sample(range(5, 60, 5), 2))
    for lo, hi in zip([0, *cuts], [*cuts, 99], strict=True):  # a delivery holds whole snapshots, in any order of rows
        part = [r for r in rows if at(lo) <= r[3] < at(hi)]
        rnd.shuffle(part)
        spark.createDataFrame(part + part[:2], schema).repartition(3).write.mode("append").parquet(src)
        q = so.start(so.stateful_counter_delta(so.file_stream(spark, src, schema), keys, "snapshot_time", ["v"]), "parquet",
                     str(tmp_path / "ck"), available_now=True, path=sink)
        q.awaitTermination()
    whole = counter_delta(spark.createDataFrame(rows, schema), keys, "snapshot_time", ["v"])
    columns = [*keys, "snapshot_time", "v", "note", "v_delta", "delta_seconds"]
    want = sorted(map(repr, (tuple(r) for r in whole.filter("name is not null").select(*columns).collect())))
    got = sorted(map(repr, (tuple(r) for r in spark.read.parquet(sink).filter(F.col("name").isNotNull()).select(*columns).collect())))
    assert got == want
