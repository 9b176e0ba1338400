"""Resumable stages: a stage's table is written once and read again by every later run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage below ``folder``; built only if no complete one is there.

    A table counts as complete once Spark's ``_SUCCESS`` mark lies beside its files, so what a lost run left behind is written anew.
    """
    path = f"{folder.rstrip('/')}/{name}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
