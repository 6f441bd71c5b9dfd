"""SQL functions against the column functions, trend tiers, baseline rules, extracts and their windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import scalars as sc
from fleetscope.functions import sql_surface as surface
from fleetscope.operators import dims
from fleetscope.operators.trends import TREND_TIERS, trend_rollup, trend_tiers
from fleetscope.sources import extracts

D = dt.datetime
VALUES = {
    "string": [None, "", "a\t b  c\n d", "C:\\data\\x.mdf", "\\\\srv\\share\\f", "12.5 MB", "1,234.5", "(12ms)PAGEIOLATCH_SH:x", "15.0.2000.5", "a.b.c", "tempdb",
               "SQLAgent - TSQL JobStep (Job 0xAB12AB12AB12AB12AB12AB12AB12AB12 : Step 1)", '<event timestamp="2024-01-01T00:00:00.123Z">', "it's", "LCK_M_X", "T-SQL"],
    "bigint": [None, 0, 999, 123_456, 10**9, 7 * 10**14], "int": [None, 0, 1, 2, 13, 15, 20240131, 123456, -1],
    "timestamp_ntz": [None, D(2024, 1, 1), D(2024, 2, 29, 23, 59, 59), D(1999, 12, 31, 12, 30, 1)],
}
#: Parameters whose values a function limits.
LIMITS = {("parsename", "part"): [None, 1, 2, 3, 4], ("time_group", "minutes"): [None, 1, 15, 1440], ("space_to_bytes", "text"): [None, "12.50 MB", "3 KB", "1 GB"],
          ("grouped_number", "text"): [None, "1,234.5", "7"], ("statement_text", "start_offset"): [None, 0, 4], ("statement_text", "end_offset"): [None, -1, 8],
          ("add_duration_ms", "ms"): [None, 0, -5, 123_456, 10**9],
          ("yyyymmdd_hhmmss_to_ts", "date_int"): [None, 20240131], ("yyyymmdd_hhmmss_to_ts", "time_int"): [None, 0, 123456]}


@pytest.mark.parametrize("name", list(surface.CATALOGUE))
def test_both_surfaces_agree(spark, name):
    params, fn = surface.CATALOGUE[name]
    columns = [p.split() for p in params.split(", ")]
    values = [LIMITS.get((name, c), VALUES[kind]) for c, kind in columns]
    n = max(map(len, values))
    rows = [tuple(v[(i + j) % len(v)] for j, v in enumerate(values)) for i in range(n * 3)]
    df = spark.createDataFrame(rows, params)
    df.createOrReplaceTempView("surface_rows")
    called = surface.register_functions(spark, [name], prefix="t_")[0]
    names = [c for c, _ in columns]
    got = spark.sql(f"SELECT {called}({', '.join(names)}) AS x FROM surface_rows").collect()
    want = df.select(fn(*[F.col(c) for c in names]).alias("x")).collect()
    assert got == want and any(r.x is not None for r in want)
    plan = spark.sql(f"SELECT {called}({', '.join(names)}) AS x FROM surface_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_parsename_of_a_column_equals_each_part(spark):
    surface.register_functions(spark, ["parsename"], prefix="t_")
    df = spark.createDataFrame([("srv.db.dbo.t",), ("a.b",), ("a.b.c.d.e",), (None,)], "n string")
    df.createOrReplaceTempView("names")
    for part in (1, 2, 3, 4):
        assert spark.sql(f"SELECT t_parsename(n, {part}) AS x FROM names").collect() == df.select(sc.parsename("n", part).alias("x")).collect()


def test_tiers_equal_roll_ups_from_raw(spark):
    rows = [(k, D(2024, 1, 1) + dt.timedelta(seconds=37 * i * (1 + len(k))), i, None if i % 11 == 0 else (i * i) % 97) for k in ("a", "bb") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id bigint, v bigint")
    now = D(2024, 3, 1)
    got = trend_tiers(df, ["k"], "v", now, time="t", tie="id")
    columns = ["k", "t", "interval_minutes", "value_avg", "value_min", "value_max", "value_sum", "value_count", "valid_until"]
    want = set()
    for minutes, days in TREND_TIERS:
        want |= {tuple(r) for r in trend_rollup(df, ["k"], "v", minutes, days, now, time="t").filter("value_count > 0").select(*columns).collect()}
    assert {tuple(r) for r in got.select(*columns).collect()} == want
    last = {(r.k, r.t): r.value_last for r in got.filter("interval_minutes = 60").collect()}
    for (k, t), v in last.items():
        assert v == max((x for x in rows if x[0] == k and t <= x[1] < t + dt.timedelta(hours=1) and x[3] is not None), key=lambda x: x[1])[3]
    # what exists is not emitted again, and the coarser tiers are whole nevertheless
    some = got.filter("interval_minutes = 1 and minute(t) < 30 or interval_minutes = 60 and k = 'a'")
    rest = trend_tiers(df, ["k"], "v", now, time="t", tie="id", existing=some)
    whole = sorted(map(repr, got.collect()))
    assert sorted(map(repr, [*some.collect(), *rest.collect()])) == whole
    assert trend_tiers(df.limit(0), ["k"], "v", now, time="t").count() == 0
    with pytest.raises(ValueError):
        trend_tiers(df, ["k"], "v", now, time="t", tiers=((2, 1), (5, 1)))


def test_baseline_sweep_and_immutable_dates(spark):
    d = lambda n: D(2024, 1, n)
    rows = [("a", 1, d(1), d(10)), ("a", 2, d(10), d(12)), ("a", 3, d(5), d(6)), ("a", 4, d(5), d(20)), ("b", 5, d(5), d(6)), ("a", 6, d(7), d(7)),
            ("a", 7, None, d(9)), ("a", 8, d(11), d(13))]
    b = spark.createDataFrame(rows, "sql_instance string, baseline_id int, baseline_start timestamp_ntz, baseline_end timestamp_ntz")
    got = {(r.subject, r.detail) for r in dims.baseline_overlaps(b).collect()}
    assert got == {("a|3", 1), ("a|4", 2), ("a|2", 1), ("a|8", 2)}
    old = spark.createDataFrame([("a", 1, d(1), d(10)), ("a", 2, d(9), d(12)), ("a", 3, d(4), d(7)), ("a", 7, d(1), d(9)), ("z", 99, d(1), d(2))], b.schema)
    assert {(r.subject, r.detail) for r in dims.baseline_date_changes(b, old).collect()} == {("2", 1), ("3", 2), ("7", 1)}
    assert dims.baseline_overlaps(b.limit(0)).count() == 0


def test_seven_extracts_and_idempotent_windows(spark, tmp_path):
    base = str(tmp_path / "out")
    at = lambda h: D(2024, 1, 1, h)

    def view(name, hours):
        d = extracts.CATALOGUE[name]
        columns = d.columns or ("volume", "snapshot_time")
        rows = [tuple(at(h) if c in ("snapshot_time", "run_date", "end_date") else f"{c}{h}" for c in columns) for h in hours]
        return spark.createDataFrame(rows, ", ".join(f"{c} {'timestamp_ntz' if c in ('snapshot_time', 'run_date', 'end_date') else 'string'}" for c in columns)) \
            .withColumn("other", F.lit(1))

    def run(now, hours):
        return extracts.run_extracts({e.name: lambda e=e: view(e.name, hours) for e in extracts.EXTRACTS}, base, now)

    assert len(extracts.EXTRACTS) == 7 and set(run(at(3), [1, 2, 3])) == set(extracts.CATALOGUE)
    first = run(at(5), [1, 2, 3, 4, 5, 6])
    assert all(w == (at(3), at(5)) for w in first.values())
    assert all(w is None for w in run(at(5), [1, 2, 3, 4, 5, 6]).values())  # nothing is written twice
    assert all(w is None for w in run(at(4), [4]).values())
    for e in extracts.EXTRACTS:
        got = extracts.read_extract(spark, base, e.name)
        assert got.count() == (5 if e.time else 6)
        assert list(got.columns) == (list(e.columns) or ["volume", "snapshot_time", "other"])
    # a run that died before its window was acknowledged leaves files that nobody reads, and is repeated
    d = extracts.CATALOGUE["checks"]
    view("checks", [6, 6, 6]).select(*d.columns).write.parquet(f"{base}/checks/window=20240101T060000000000")
    assert extracts.read_extract(spark, base, "checks").count() == 5
    extracts.run_extract(view("checks", [6, 7]), d, base, at(7))
    assert sorted(r.snapshot_time.hour for r in extracts.read_extract(spark, base, "checks").collect()) == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(FileNotFoundError):
        extracts.read_extract(spark, base, "nothing")
