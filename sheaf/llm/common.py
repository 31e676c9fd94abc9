"""Helpers that the training-data operators share: inputs, scratch tables, folds, samples and lookups."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key with more than one in SHARES of all rows is hot; so there are fewer than SHARES hot keys.
SHARES = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named, one is made up if all tasks run in this machine's driver process (tests);
    on a cluster a local folder would be another one on each executor, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = sc_dir.get() if sc_dir.isDefined() else None
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/sheaf-checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
        _fs(spark, base, "deleteOnExit")
    return base.rstrip("/")


def _fs(spark: SparkSession, path: str, method: str, *args):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), method)(hpath, *args)


#: Tables that ``stored`` wrote: path, and a weak reference of the JVM to the index of its files.
_tables: list[tuple[str, object]] = []


def sweep(spark: SparkSession) -> None:
    """Delete the stored tables that no plan refers to any more.

    All plans over a table share one index of its files.  Once the JVM has collected that, nothing
    can read the table again, lazy plans included.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for entry in _tables[:]:
        path, index = entry
        if index.get() is None:
            _tables.remove(entry)
            _fs(spark, path, "delete", True)


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: later stages depend on replicated files, not on shuffle output of
    executors that may be lost.  The table goes when the driver's JVM ends at the latest.  With
    ``free``, tables and shuffle files that nothing refers to any more are deleted now.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _fs(spark, path, "deleteOnExit")
    if free:
        del df
        sweep(spark)
    out = spark.read.schema(schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def id_fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def workers(spark: SparkSession) -> int:
    """Partitions for work that is spread by hand: what the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def at_most(df: DataFrame, rows: int, total: int, *by: str, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows of ``df`` (which has ``total``), the first by a hash of columns ``by``.

    Those under a share of the hash's range a little above rows / total are ordered and cut, so
    what is ordered is bounded, too, whatever the size of the table.
    """
    if total <= rows:
        return df
    h = F.shiftrightunsigned(F.xxhash64(*by, F.lit(seed)), 1)
    some = df.where(h < int((1 << 63) * min(1.0, (rows + 4 * rows**0.5) / total)))
    return some.orderBy(h, *by).limit(rows)


def lookup(rows: DataFrame, key: str | list[str], found: DataFrame, values: list[str], how: str = "left", n: str | None = None) -> DataFrame:
    """``rows`` with ``values`` of ``found``, which has one row for each value of its ``key`` columns.

    Hot keys of ``rows`` are fewer than SHARES, so their part of ``found`` is broadcast; only the
    other rows are dealt by key.  ``n`` names a column of ``found`` with the number of rows of each
    key, if it has that.  A null key has no values; ``how`` is left or inner.
    """
    keys = [key] if isinstance(key, str) else key
    marks = [f"__k{i}" for i in range(len(keys))]
    whole = ~F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys])
    named = [F.col(k).alias(m) for k, m in zip(keys, marks)]
    counts = found.select(*named, F.col(n).alias("__n")) if n else rows.where(whole).groupBy(*named).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("s"), F.max("__n").alias("m")).first()
    least = max(SHARES, (total["s"] or 0) // SHARES)
    right = found.select(*named, *[F.col(v).alias(f"__{v}") for v in values])

    def join(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        on = F.lit(True)
        for k, m in zip(keys, marks):
            on = on & (F.col(k) == F.col(m))
        return a.join(b, on, kind)

    def with_values(a: DataFrame, b: DataFrame) -> DataFrame:
        return join(a, b, how).select(*rows.columns, *[F.col(f"__{v}").alias(v) for v in values])

    known = rows.where(whole)
    if (total["m"] or 0) > least:
        hot = F.broadcast(counts.where(F.col("__n") > least).select(*marks))
        warm = right.join(hot, marks, "left_semi")
        out = with_values(join(known, hot, "left_anti"), right).unionByName(with_values(join(known, hot, "left_semi"), F.broadcast(warm)))
    else:
        out = with_values(known, right)
    if how == "left":
        blank = [F.lit(None).cast(found.schema[v].dataType).alias(v) for v in values]
        out = out.unionByName(rows.where(~whole).select(*rows.columns, *blank))
    return out
