"""Small text formats: sizes, durations and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size suffixes.
UNITS = {"": 1, "B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "K": 1024, "KIB": 1024, "M": 1024**2, "MIB": 1024**2, "G": 1024**3, "GIB": 1024**3}


def parse_size(text: Column) -> Column:
    """Bytes of sizes such as ``10MiB`` or ``1.5 GB``; null where the text is no size."""
    clean = F.upper(F.trim(text))
    number = F.try_to_number(F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]*)$", 1), F.lit("999999999999.999999"))
    unit = F.regexp_extract(clean, r"^[0-9]+(?:\.[0-9]+)?\s*([A-Z]*)$", 1)
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[unit]
    return F.when(clean.rlike(r"^[0-9]+(\.[0-9]+)?\s*[A-Z]*$"), F.floor(number * factor)).cast("long")


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(n / 1024**4, 1), F.lit(" TiB")))


def human_elapsed(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def rate_mib(n: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(n / (1024.0 * 1024.0), seconds), F.lit(0.0))


def plural(n: Column, one: str) -> Column:
    """A count with its noun."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {one}s"))


def truncated(value: Column, width: int) -> Column:
    """At most ``width`` characters, the last one an ellipsis where something is left out."""
    return F.when(F.length(value) <= width, value).otherwise(F.concat(F.substring(value, 1, width - 1), F.lit("\u2026")))


def bar_cells(done: Column, total: Column, width: int) -> Column:
    """Filled cells of a progress bar of ``width`` cells."""
    return F.when(total > 0, F.least(F.floor(done * width / total), F.lit(width))).otherwise(width).cast("long")


def report_line(line: Column) -> dict[str, Column]:
    """Fields of an invocation's REPORT log line; null where the line is none."""
    pick = lambda pattern, kind: F.when(line.contains("REPORT RequestId:"), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind))
    return {
        "request_id": pick(r"REPORT RequestId:\s*(\S+)", "string"),
        "duration_ms": pick(r"\bDuration:\s*([0-9.]+) ms", "double"),
        "billed_duration_ms": pick(r"Billed Duration:\s*([0-9]+) ms", "long"),
        "memory_size_mb": pick(r"Memory Size:\s*([0-9]+) MB", "long"),
        "max_memory_used_mb": pick(r"Max Memory Used:\s*([0-9]+) MB", "long"),
    }
