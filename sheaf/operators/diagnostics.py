"""Counters of reports, retries and benchmark runs as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.tuning import is_throttle
from sheaf.operators.intervals import fetch_measures

STATUSES = ("uploaded_new", "uploaded_changed", "skipped_unchanged", "conditional_conflict", "deleted_extra", "error")
#: Live statuses and what a dry run calls them.
DRY = {
    "uploaded_new": "would_upload_new", "uploaded_changed": "would_upload_changed", "skipped_unchanged": "skipped_unchanged",
    "deleted_extra": "would_delete_extra", "conditional_conflict": "error", "error": "error",
}


def sync_summary(operations: DataFrame, zip_files: int | DataFrame, destination_objects: int | DataFrame) -> DataFrame:
    """One row of counters, also for no operations."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = operations.agg(
        n("uploaded_new").alias("uploaded_new"), n("uploaded_changed").alias("uploaded_changed"), n("skipped_unchanged").alias("skipped_unchanged"),
        n("conditional_conflict").alias("conditional_conflicts"), n("deleted_extra").alias("deleted_extra"), n("error").alias("errors"),
    )
    return _headed(counts, zip_files, destination_objects)


def dry_summary(operations: DataFrame, zip_files: int | DataFrame, destination_objects: int | DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    counts = operations.agg(
        n("would_upload_new").alias("would_upload_new"), n("would_upload_changed").alias("would_upload_changed"), n("skipped_unchanged").alias("skipped_unchanged"),
        n("would_delete_extra").alias("would_delete_extra"), n("error").alias("errors"),
    )
    return _headed(counts, zip_files, destination_objects)


def _headed(counts: DataFrame, zip_files, destination_objects) -> DataFrame:
    """Prepend the two totals, given as numbers or as tables to be counted in the same plan."""
    head = counts
    for name, of in (("zip_files", zip_files), ("destination_objects", destination_objects)):
        one = of.agg(F.count("*").alias(name)) if isinstance(of, DataFrame) else None
        head = head.crossJoin(one) if one is not None else head.withColumn(name, F.lit(of).cast("long"))
    return head.select("zip_files", "destination_objects", *counts.columns)


def dry_status(status):
    return F.create_map(*[F.lit(x) for kv in DRY.items() for x in kv])[status]


def put_failures(attempts: DataFrame, keys: list[str] = []) -> DataFrame:
    """Failed attempts by error code: failures and whether the code is a throttle."""
    failed = attempts.where("error_code is not null")
    return failed.groupBy(*keys, "error_code").agg(F.count("*").alias("failures"), F.first(is_throttle(F.col("error_code"))).alias("throttled"))


def put_diagnostics(attempts: DataFrame) -> DataFrame:
    """One row: attempts, failures, retries, throttles and a sorted map of failures by code."""
    codes = put_failures(attempts).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "failures")))).alias("failures_by_error_code"))
    sums = attempts.agg(
        F.count("*").alias("attempts"), F.count("error_code").alias("failed_attempts"), F.count_if(F.col("attempt") > 1).alias("retry_attempts"),
        F.count_if(is_throttle(F.col("error_code"))).alias("throttled_attempts"),
    )
    return sums.crossJoin(codes)


def source_diagnostics(gets: DataFrame, keys: list[str]) -> DataFrame:
    """Per archive: GET attempts, retries, errors, fetched and unique bytes and amplification."""
    counts = gets.groupBy(*keys).agg(
        F.count("*").alias("source_get_attempts"), F.count_if(F.col("attempt") > 1).alias("source_get_retries"), F.count_if(~F.col("ok")).alias("source_get_errors"), F.count_if("ok").alias("fetched_blocks"),
    )
    return counts.join(fetch_measures(gets.where("ok"), keys), keys, "left").fillna(0)


def planned_by_phase(phases: DataFrame) -> DataFrame:
    """Entries, blocks and bytes planned over all phases (an entry hashed and uploaded counts twice)."""
    return phases.agg(F.sum("planned_entries").alias("planned_entries"), F.sum("planned_blocks").alias("planned_blocks"), F.sum("planned_bytes").alias("planned_bytes"))


def bench_aggregate(samples: DataFrame) -> DataFrame:
    """Benchmark samples by (memory_mb, fixture, run, catalog): counts, and min, median and max of
    the good samples."""
    good = lambda c: F.when(F.col("ok"), F.col(c)).cast("double")
    stats = [f(good(c)).alias(f"{c}_{name}") for c in ("duration_ms", "max_memory_used_mb") for name, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    return samples.groupBy("memory_mb", "fixture", "run", "catalog").agg(
        F.count("*").alias("samples"), F.count_if("ok").alias("ok_samples"), F.count_if(~F.col("ok")).alias("failed_samples"), *stats
    )


def merge_code_maps(samples: DataFrame, keys: list[str], column: str = "failures_by_error_code") -> DataFrame:
    """Sum maps of counts by code over each group."""
    each = samples.select(*keys, F.explode(column).alias("code", "n")).groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias(column))


def throttled_log(issues: DataFrame, order: list[str], first: int = 20, every: int = 100) -> DataFrame:
    """Of a run's issues the first few and then every hundredth."""
    from pyspark.sql.window import Window

    numbered = issues.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(*order)))
    return numbered.where((F.col("n") <= first) | (F.col("n") % every == 0))


def observed(operations: DataFrame, name: str = "progress") -> tuple[DataFrame, object]:
    """``operations`` with live counters that a run fills: (DataFrame, Observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return operations.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *counts), seen


#: Runs in the order in which a report shows them.
RUNS = ("full", "update", "update_ignored")


def bench_order(cases: DataFrame) -> DataFrame:
    """Add ``place``: by memory, fixture, run and sample.  Cases are a configuration, thus few."""
    from pyspark.sql.window import Window

    run = F.coalesce(*[F.when(F.col("run") == r, i) for i, r in enumerate(RUNS)], F.lit(len(RUNS)))
    return cases.withColumn("place", F.row_number().over(Window.orderBy("memory_mb", "fixture", run, "sample")).cast("long"))


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A small aggregate as a Markdown table."""
    rows = [[("" if v is None else f"{v:g}" if isinstance(v, float) else str(v)) for v in r] for r in df.orderBy(*order).toLocalIterator()]
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
