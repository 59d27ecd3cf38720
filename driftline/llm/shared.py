"""Tables that outlive an executor: written once to the folder all nodes share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir


#: Paths given out since each settled() that runs began.
_given: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _given[-1:]:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: computed once, lineage cut, any lost
    executor's share can be read again."""
    return written_at(df, new_path(df.sparkSession, name), codec)


def written_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Takes out a work table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make() from a table of their own; the work tables that were written on the way are deleted."""
    _given.append([])
    try:
        df = make()
    finally:
        paths = _given.pop()
    out = written(df, name)
    for path in paths:
        deleted(df.sparkSession, path)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
