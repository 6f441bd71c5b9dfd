from pyspark.sql import functions as F

from fleetscope.sources import fixtures as fx
from fleetscope.sources.sinks import latest_version, write_facts, write_version


def test_fact_layout_prunes_by_type_and_date(spark, sf_small, tmp_path):
    s = fx.fx_sample(spark, sf_small)
    path = str(tmp_path / "facts")
    write_facts(s, path)
    back = spark.read.parquet(path)
    assert back.count() == s.count()
    q = back.filter((F.col("snapshot_type_id") == 2) & (F.col("snapshot_date") == F.lit("2024-01-05").cast("date")))
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain()
    plan = buf.getvalue()
    assert "PartitionFilters" in plan and "snapshot_type_id" in plan
    assert q.count() == s.filter((F.col("snapshot_type_id") == 2)
                                 & (F.to_date("snapshot_time") == F.lit("2024-01-05").cast("date"))).count()


def test_versions_read_latest_complete(spark, tmp_path):
    base = str(tmp_path / "dim")
    write_version(spark.range(3), base, "001")
    write_version(spark.range(5), base, "002")
    assert latest_version(spark, base).count() == 5
