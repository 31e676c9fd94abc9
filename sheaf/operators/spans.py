"""Byte ranges: entry spans, block planning and lookups between blocks and spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.tuning import BLOCK_SIZE, MERGE_GAP, PART_SIZE
from sheaf.operators.ranges import PART, earlier, ranged, with_carry, within


def span_ends(records: DataFrame, archive: str = "archive", offset: str = "header_offset", limit: str = "cd_start") -> DataFrame:
    """Add ``span_end``: the next greater header offset of the archive, at most the directory's start.

    Give it all records, before any selection: entries that are not selected still end spans.
    """
    parts = with_carry(ranged(records, [archive], [offset]), [archive], F.min(offset), lambda c: F.lead(c).over(Window.partitionBy(archive).orderBy(PART)), "_next")
    # from the last on, since a frame that only grows is one pass
    later = within([archive], F.col(offset).desc()).rangeBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("span_end", F.least(F.coalesce(F.min(offset).over(later), "_next", limit), F.col(limit))).drop("_next", PART)


def span_error(start: str, end: str, length: str, limit: str):
    return (
        F.when(F.col(start) >= F.col(length), "entry starts beyond the archive")
        .when(F.col(start) >= F.col(limit), "entry starts beyond the central directory")
        .when(F.col(end) <= F.col(start), "entry span is empty")
    )


def _folded(archive: str, block_size: int, merge_gap: int):
    """Greedy merges of sorted spans, one pass: the state is one open block."""

    def run(batches):
        at = start = end = None
        kind = None
        for batch in batches:
            kind, out = batch.schema.field(archive).type, []
            for row in zip(*(batch.column(c).to_pylist() for c in (archive, "island", "start", "end"))):
                if at == row[:2] and row[2] - end <= merge_gap and max(end, row[3]) - start <= block_size:
                    end = max(end, row[3])
                    continue
                if at is not None:
                    out.append((at[0], start, end))
                at, start, end = row[:2], row[2], row[3]
            if out:
                yield _spans(out, archive, kind)
        if at is not None:
            yield _spans([(at[0], start, end)], archive, kind)

    def _spans(rows, name, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (kind, pa.int64(), pa.int64()))], [name, "start", "end"])

    return run


def plan_blocks(spans: DataFrame, *, block_size: int = BLOCK_SIZE, merge_gap: int = MERGE_GAP, archive: str = "archive", length: str | None = None) -> DataFrame:
    """Blocks (archive, block_id, start, end inclusive) that cover the spans [start, end).

    Neighbours are merged greedily while the gap is at most ``merge_gap`` and the merged block at
    most ``block_size``; longer spans are split.  A gap beyond the running maximum of ends always
    cuts, so the greedy fold runs within such islands only.
    """
    if length:
        spans = spans.withColumn("end", F.least("end", length))
    spans = spans.where(F.col("end") > F.col("start")).select(archive, "start", "end")
    keys, order = [archive], within([archive], "start", "end")
    parts = with_carry(ranged(spans, keys, ["start", "end"]), keys, F.max("end"), lambda c: F.max(c).over(earlier(keys)), "_reach")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    cut = parts.withColumn("cut", F.when(F.coalesce(F.col("start") > reach + merge_gap, F.lit(True)), F.col("start")))
    # an island is named by its start
    begun = with_carry(cut, keys, F.max("cut"), lambda c: F.max(c).over(earlier(keys)), "_island")
    islands = begun.withColumn("island", F.coalesce(F.max("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_island"))
    sorted_ = islands.repartition(archive, "island").sortWithinPartitions(archive, "island", "start", "end")
    schema = islands.select(archive, "start", "end").schema
    merged = sorted_.select(archive, "island", "start", "end").mapInArrow(_folded(archive, block_size, merge_gap), schema)
    pieces = merged.withColumn("at", F.explode(F.expr(f"sequence(start, end - 1, {block_size}L)")))
    blocks = pieces.select(archive, F.col("at").alias("start"), (F.least(F.col("at") + block_size, F.col("end")) - 1).alias("end"))
    counted = with_carry(ranged(blocks, keys, ["start", "end"]), keys, F.count("*"), lambda c: F.sum(c).over(earlier(keys)), "_before")
    return counted.withColumn("block_id", F.row_number().over(order) + F.coalesce("_before", F.lit(0).cast("long"))).select(archive, "block_id", "start", "end")


def block_claims(blocks: DataFrame, entries: DataFrame, *, step: int = BLOCK_SIZE, archive: str = "archive") -> DataFrame:
    """How many entries [start, end) each block serves: (archive, block_id, claims).

    A range join as an equi-join: both sides are spread over the cells of ``step`` bytes that they
    touch, and overlaps are checked in the cell where they begin.
    """
    cells = lambda df, end: df.withColumn("cell", F.explode(F.expr(f"sequence(start div {step}, ({end}) div {step})")))
    b = cells(blocks.select(archive, "block_id", "start", "end"), "end").select(F.col(archive).alias("a"), "block_id", F.col("start").alias("b0"), F.col("end").alias("b1"), F.col("cell").alias("bc"))
    e = cells(entries.where(F.col("end") > F.col("start")).select(archive, "start", "end"), "end - 1")
    met = b.join(e, (F.col("a") == F.col(archive)) & (F.col("bc") == F.col("cell")) & (F.col("b0") < F.col("end")) & (F.col("start") < F.col("b1") + 1))
    met = met.where(F.col("cell") == F.expr(f"greatest(b0, start) div {step}"))
    counts = met.groupBy("a", F.col("block_id").alias("b")).agg(F.count("*").alias("claims"))
    found = blocks.join(counts, (F.col(archive) == F.col("a")) & (F.col("block_id") == F.col("b")), "left")
    return found.select(archive, "block_id", F.coalesce("claims", F.lit(0)).alias("claims"))


def point_to_block(points: DataFrame, blocks: DataFrame, *, archive: str = "archive", at: str = "offset") -> DataFrame:
    """Add ``block_id``: the last block that starts at or before a point, null beyond its end.

    An as-of join by one sort: blocks and points are merged and the last block seen is carried on.
    """
    marks = blocks.select(archive, F.col("start").alias(at), F.struct("block_id", "end").alias("block"), F.lit(0).alias("side"))
    probes = points.withColumns({"block": F.lit(None).cast(marks.schema["block"].dataType), "side": F.lit(1)})
    both = marks.unionByName(probes, allowMissingColumns=True)
    last = F.max_by("block", F.when(F.col("side") == 0, F.col(at)))
    parts = with_carry(ranged(both, [archive], [at, "side"]), [archive], last, lambda c: F.last(c, ignorenulls=True).over(earlier([archive])), "_block")
    seen = F.last("block", ignorenulls=True).over(within([archive], at, "side").rowsBetween(Window.unboundedPreceding, 0))
    found = parts.withColumn("b", F.coalesce(seen, "_block")).where("side = 1")
    return found.select(*points.columns, F.when(F.col("b.end") >= F.col(at), F.col("b.block_id")).alias("block_id"))


def multipart_parts(objects: DataFrame, *, size: str = "size", part_size: int = PART_SIZE) -> DataFrame:
    """Parts of multipart uploads: exact multiples have no empty tail; an empty object has none."""
    numbered = objects.where(F.col(size) > 0).withColumn("part_number", F.explode(F.expr(f"sequence(1L, ({size} + {part_size} - 1) div {part_size})")))
    first = (F.col("part_number") - 1) * part_size
    return numbered.withColumns({"part_start": first, "part_bytes": F.least(F.lit(part_size).cast("long"), F.col(size) - first)})
