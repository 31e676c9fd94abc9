"""Incremental synchronisation: archives that arrive in a folder are extracted once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf import api
from sheaf.plans.options import SyncOptions


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of archives as they arrive (contents are not read)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(folder)
    return stream.select("path", "modificationTime", "length")


def sync_arrivals(spark: SparkSession, folder: str, root: str, checkpoint: str, opts: SyncOptions = SyncOptions(), done=None) -> StreamingQuery:
    """Run a synchronisation for each new archive, oldest first; ``done`` gets (path, report).

    The checkpoint remembers the archives that were seen; a batch that is run again finds its
    writes in place and skips them.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        for r in rows.orderBy("modificationTime", "path").toLocalIterator():
            path = r["path"].removeprefix("file:").replace("//", "/", 1) if r["path"].startswith("file:") else r["path"]
            report = api.sync(spark, "/" + path.lstrip("/"), root, opts)
            if done:
                done(path, report)

    return arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
