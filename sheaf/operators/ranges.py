"""Running values along a sort order without a task for each key: ranges of rows, and what earlier ranges carry on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sheaf.sources.scratch import kept

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` stored with ``_part``, the number of its range of (keys, order); equal rows share one."""
    return kept(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def within(keys: list[str], *order: str | Column) -> WindowSpec:
    """The rows of a key in one range, in order."""
    return Window.partitionBy(*keys, PART).orderBy(*order)


def earlier(keys: list[str]) -> WindowSpec:
    """The ranges of a key that come before one."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(parts: DataFrame, keys: list[str], value: Column, carry: Callable[[str], Column], name: str) -> DataFrame:
    """Add ``name``: what ``carry`` makes of the ``value`` (an aggregate) of each of a key's ranges."""
    each = parts.groupBy(*keys, PART).agg(value.alias("_value"))
    found = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PART).alias("_p"), carry("_value").alias(name))
    same = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return parts.join(found, same, "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])
