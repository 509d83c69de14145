"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new temporary one, for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    # A written table needs its shuffles no more: Spark deletes their files when the write ends.
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def measured(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and what aggregates of the rows (aliased columns) came to while they were written."""
    seen = Observation()
    out = materialize(df.observe(seen, *measures), label)
    return out, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._siltstone_path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table that this application wrote."""
    _delete(spark, f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")
