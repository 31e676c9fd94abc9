"""Pack a table's texts into archives and read them back: a whole-path query."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sheaf.plans.options import PackOptions
from sheaf.sources.sinks import zip_chunks
from sheaf.sources.zipfmt import read_directory, span_ends, verified

#: Pages of about so many bytes are one archive.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """(page_id, bytes) of a batch, a few at a time: no more than ``most`` bytes, or a single page."""
    held, size = [], 0
    for i in range(batch.num_rows):
        html = (batch.column("html")[i].as_py() or "").encode()
        if held and size + len(html) > most:
            yield held
            held, size = [], 0
        held.append((batch.column("page_id")[i].as_py(), html))
        size += len(html)
    if held:
        yield held


def pages_roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every page packed and decoded again within one task per group of pages: page_id, bytes, md5.

    The groups' archives are made and read in memory of the task, so no folder needs to be shared.
    A group is a slice of a batch, and contents are digested where they are decoded.
    """
    names = ["page_id", "bytes", "md5"]

    def run(batches):
        for batch in batches:
            for held in slices(batch, SLICE):
                f = io.BytesIO(b"".join(zip_chunks(((f"p/{i}.html", h) for i, h in held), PackOptions(), {})))
                records, start, _ = read_directory(f)
                ends = span_ends(records, start)
                read = ((int(r.raw_path[2:-5]), verified(f, r, ends[r.header_offset])) for r in records if r.raw_path.startswith("p/"))
                rows = [(i, len(c), hashlib.md5(c).hexdigest()) for i, c in read]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, bytes long, md5 string")
