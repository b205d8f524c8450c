"""Intermediate tables in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a job when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a session with a local master makes one of its own where that is
    unset; on a cluster, executors would each write to their own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        base = tempfile.mkdtemp(prefix="slipmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def run_folder(spark: SparkSession) -> str:
    """All scratch tables of one application are in one folder."""
    return f"{folder(spark).rstrip('/')}/slipmark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_run(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application, once none of its results is read any more; tells whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind. A lost task of the write itself still finds them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, and what is read twice is computed once.

    A lost executor only costs a re-read of the files. The shuffle files that made them are removed.
    """
    path = new_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def forget(table: DataFrame) -> None:
    """Delete a table that ``stored`` gave, once no plan reads it any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
