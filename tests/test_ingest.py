"""Ingest operators on literal frames."""

import datetime as dt

from fleetscope.sources import ingest as ing

D = dt.datetime


def test_errorlog_keyword_pair_and_strict_watermark(spark):
    lines = spark.createDataFrame([
        (D(2024, 1, 1, 10), 1, "x", " Login failed for user 'a'\r\n"),
        (D(2024, 1, 1, 11), 1, "x", "Login failed for user 'b'"),
        (D(2024, 1, 1, 12), 1, "x", "Login succeeded"),
        (D(2024, 1, 1, 12), 2, "x", "Login failed for user 'c'"),
    ], "log_date timestamp_ntz, log_type_id int, attribute_value string, text string")
    kw = spark.createDataFrame([(1, "login", "FAILED", 1)], "keyword_id int, keyword1 string, keyword2 string, "
                                                             "log_type_id int")
    seen = spark.createDataFrame([(1, 1, D(2024, 1, 1, 10))], "keyword_id int, log_type_id int, "
                                                               "log_date timestamp_ntz")
    out = ing.errorlog_ingest(lines, kw, seen).collect()
    assert [(r.log_date.hour, r.text) for r in out] == [(11, "Login failed for user 'b'")]
    fresh = sorted(r.text for r in ing.errorlog_ingest(lines, kw).collect())
    assert fresh == ["Login failed for user 'a'", "Login failed for user 'b'"]


def test_import_facts_guards(spark):
    cols = "sql_instance string, snapshot_type_id int, snapshot_time timestamp_ntz, k int"
    remote = spark.createDataFrame([("s", 1, D(2024, 1, 1, h), 1) for h in range(1, 6)], cols)
    local = spark.createDataFrame([("s", 1, D(2024, 1, 1, h), 1) for h in range(1, 3)], cols)
    headers = spark.createDataFrame([("s", 1, D(2024, 1, 1, h)) for h in (1, 2, 3, 4)],
                                    "sql_instance string, snapshot_type_id int, snapshot_time timestamp_ntz")
    out = sorted(r.snapshot_time.hour for r in
                 ing.import_facts(remote, local, headers, ["sql_instance", "snapshot_type_id", "snapshot_time", "k"])
                 .collect())
    assert out == [3, 4]  # newer than local, not newer than the newest header, header present


def test_header_watermark_and_job_history(spark):
    cols = "sql_instance string, snapshot_type_id int, snapshot_time timestamp_ntz"
    remote = spark.createDataFrame([("s", 1, D(2024, 1, 1, h)) for h in (1, 2, 3)] + [("t", 1, D(2024, 1, 1, 1))], cols)
    local = spark.createDataFrame([("s", 1, D(2024, 1, 1, 2))], cols)
    got = sorted((r.sql_instance, r.snapshot_time.hour) for r in ing.header_watermark(remote, local).collect())
    assert got == [("s", 3), ("t", 1)]
    hist = spark.createDataFrame([(1, 20240131, 235959, 10203, 60), (2, 20240131, 0, 5, 0)],
                                 "instance_id int, run_date int, run_time int, run_duration int, off int")
    seen = spark.createDataFrame([(2,)], "instance_id int")
    r = ing.job_history_ingest(hist, seen, offset_minutes_col="off").collect()
    assert len(r) == 1 and r[0].run_duration_s == 3723
    assert r[0].run_start_utc == D(2024, 1, 31, 22, 59, 59)
    assert r[0].run_end_utc == D(2024, 1, 31, 23, 59, 59) + dt.timedelta(seconds=3723 - 3600)


def test_session_samples_filter(spark):
    df = spark.createDataFrame([(1, 20, 0, False), (2, 3, 7, False), (3, 3, 0, True), (4, 3, None, None)],
                               "sid int, duration_seconds int, blocking_session_id int, is_blocking boolean")
    assert sorted(r.sid for r in ing.session_samples(df, 15).collect()) == [1, 2, 3]
