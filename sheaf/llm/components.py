"""Connected components of an edge table: by one task up to MOST edges, by rounds of joins above."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import lookup, stored
from sheaf.llm.wordpos import lean

#: One task takes so many edges at most, whose arrays are held at once.
MOST = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges, and the smallest id that each reaches.

    In each round all roots with a smaller neighbour are hung below the smallest one, so two rounds
    halve the roots that are not finished.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[up]


def _whole(batches):
    """All edges of a partition at once."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")] for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(u, v)], ["id", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).withColumn("m", F.least("w", "u"))
    out = lookup(both.where("v > u"), "u", stored(least, "cc-large"), ["m"], "inner", n="n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-small")
    moved = lookup(down, "u", least, ["m"], "inner", n="n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (u, v) reaches.

    Up to ``most`` edges are taken by one task: rounds of joins cost the driver jobs and tasks by the
    number of partitions, however few the edges.  More go through alternating large and small stars,
    each written to the shared folder.  Their state is never more than one row per edge, and a node
    with many neighbours only ever meets their minimum, which is pre-aggregated; hot nodes get it by
    broadcast.
    """
    edges = stored(edges.where("u <> v").select("u", "v"), "cc")
    if edges.count() <= most:
        return edges.coalesce(1).mapInArrow(lean(_whole), "id long, component long")
    edges = stored(edges.distinct(), "cc")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or tuple(state) == before:
            break
        before = tuple(state)
        edges = stored(_small_star(stored(_large_star(edges), "cc")), "cc")
    ends = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(ends.select("v", "v"))
