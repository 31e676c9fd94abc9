"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is made up only where all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/sheaf-scratch/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
        _delete_at_exit(spark, base)
    return base.rstrip("/")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again: what it does is done once, also if executors are lost later."""
    path, schema = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    _delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table_of(spark: SparkSession, rows: Iterator[tuple], schema: str, chunk: int = 200_000) -> DataFrame:
    """A table of rows that the driver gets one after another; at most ``chunk`` are held at a time."""
    first = list(itertools.islice(rows, chunk))
    if len(first) < chunk:
        return spark.createDataFrame(first, schema)
    path = f"{folder(spark)}/rows-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    while first:
        spark.createDataFrame(first, schema).write.mode("append").parquet(path)
        first = list(itertools.islice(rows, chunk))
    return spark.read.schema(schema).parquet(path)
