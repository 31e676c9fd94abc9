"""Reports as JSON rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; absent values are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def sync_report(summary: DataFrame, operations: DataFrame | None, header: dict[str, str]) -> DataFrame:
    """A report document: header, summary and (if collected) operations."""
    head = [F.lit(v).alias(k) for k, v in header.items()]
    one = summary.select(*head, F.struct(*summary.columns).alias("summary"))
    if operations is not None:
        one = one.crossJoin(operations.agg(F.collect_list(F.struct(*operations.columns)).alias("operations")))
    return to_json_rows(one)


def has_errors(summary: DataFrame) -> DataFrame:
    """Conflicts are no errors."""
    return summary.select((F.col("errors") > 0).alias("has_errors"))


def transcript(summary: dict, dry: bool = False) -> str:
    """Lines for people, from a summary row as a dictionary."""
    names = {k: k.replace("_", " ") for k in summary}
    width = max(map(len, names.values()), default=0)
    head = "Dry run: nothing was changed" if dry else "Done"
    return "\n".join([head, *[f"  {names[k]:<{width}}  {v:>10,}" for k, v in summary.items()]])
