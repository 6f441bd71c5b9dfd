"""Tables and files written to the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts lineage: a lost executor costs the tasks it was running,
not the stages before. Nothing here touches a machine-local folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder (not created yet)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. With ``tidy`` Spark deletes the shuffle files of the write when
    it ends, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` returned and nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
