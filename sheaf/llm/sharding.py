"""K-d tree sharding: leaves of near equal bytes over document metadata.

The axes are source, language (the ranks of their distinct values) and size (logarithmic).
Documents with equal texts are one point, at the smallest source and language of the group.  A
node is split along its widest axis, as a share of the axis' whole width, at the weighted median,
found from distributed histograms: first over the axis' steps, then, among points on the median
step, over finer and finer ranges of a hash of the text.  All nodes of a level share each histogram
pass, so a tree of 16 leaves takes four levels whatever the size of the corpus.  Only histograms
(nodes x steps) reach the driver, and the tree is a handful of cuts: every row finds its leaf by an
expression.  Texts are dealt once, when the rows of a shard are numbered.

Nulls and odd input: a null text has 0 bytes (size 1); null sources and languages are steps of
their own; repeated rows and equal texts stay in one shard, as far as a group's own weight
allows sizes to be equal; rows that tie in all of id, text, source and language are numbered in any
order.  Texts whose 64-bit hashes are equal count as equal.  An empty table gives an empty result.
Extra columns are ignored, or carried along if named.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.common import lookup, stored

STEPS = 1024
FINE = 1024
HASH_BITS = 60
DIMS = ("d_source", "d_lang", "d_size")
#: Values of an axis that have a rank of their own (those of most bytes); others are placed by hash.
RANKED = 1_000
CHUNK_ROWS, CHUNK_BYTES = 50_000, 16 << 20


def doc_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _axis(points: DataFrame, column: str) -> DataFrame:
    """(value, step) for the values of most weight, at most RANKED, spread evenly in their order."""
    top = points.groupBy(F.col(column).alias("value")).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "value").limit(RANKED)
    top = stored(top, "kd-axis")
    rank = F.row_number().over(Window.orderBy(F.col("value").asc_nulls_first())) - 1
    return stored(top.select("value", F.expr(f"{STEPS - 1} / {max(1, top.count() - 1)}").alias("s"), rank.alias("r")).select("value", F.floor(F.col("r") * F.col("s")).cast("int").alias("step")), "kd-axis")


class Space:
    """The axes of a table, and the cuts of the tree over them."""

    def __init__(self, points: DataFrame):
        self.axes = {c: _axis(points, c) for c in ("source", "lang")}
        self.cuts: list[dict[int, tuple[str, int, int]]] = []

    def steps(self, df: DataFrame) -> DataFrame:
        """Add the steps of ``df`` (source, lang, size, h), and the hash that splits within a step."""
        for c, axis in self.axes.items():
            # at most RANKED rows
            df = df.join(F.broadcast(axis.withColumnRenamed("value", "v_")), df[c].eqNullSafe(F.col("v_")), "left").drop("v_")
            df = df.withColumn(f"d_{c}", F.coalesce("step", F.pmod(F.xxhash64(c), F.lit(STEPS)).cast("int"))).drop("step")
        size = F.least(F.lit(STEPS - 1), F.floor(F.log2(F.col("size").cast("double")) * 16)).cast("int")
        return df.withColumns({"d_size": size, "tie": F.shiftrightunsigned(F.xxhash64("h", F.lit(5)), 64 - HASH_BITS)})

    def leaf(self) -> Column:
        """The leaf of a row with steps, by the cuts made so far.

        The cuts are arrays over the nodes of all levels (root 1, children 2n and 2n + 1), and a
        row's way down is a fold over the levels.
        """
        levels = len(self.cuts)
        flat = {(1 << i) + n: cut for i, cuts in enumerate(self.cuts) for n, cut in cuts.items()}
        entry = lambda k, kind, other: F.array(*[F.lit(flat[n][k] if n in flat else other).cast(kind) for n in range(1, 1 << levels)])
        if not levels:
            return F.lit(0)
        axes, steps, ties = F.array(*[F.lit(DIMS.index(flat[n][0]) + 1 if n in flat else 1) for n in range(1, 1 << levels)]), entry(1, "int", 0), entry(2, "long", 0)
        values = F.array(*DIMS)

        def down(node: Column, _: Column) -> Column:
            value, step = F.element_at(values, F.element_at(axes, node)), F.element_at(steps, node)
            upper = (value > step) | ((value == step) & (F.col("tie") >= F.element_at(ties, node)))
            return node * 2 + upper.cast("int")

        return (F.aggregate(F.array(*map(F.lit, range(levels))), F.lit(1), down) - (1 << levels)).cast("int")


def _at_node(values: dict[int, object], kind: str) -> Column:
    """The entry of a node, as a lookup in a constant array (nodes are few: fewer than the leaves)."""
    top = max(values) + 1
    return F.element_at(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(top)]), F.col("node") + 1)


def _split_level(points: DataFrame, whole: dict[str, int]) -> dict[int, tuple[str, int, int]]:
    """For each node: (dimension, step, tie) so that points below (step, tie) weigh about half.

    ``whole`` gets the width of each axis from the first level."""
    spread = points.groupBy("node").agg(F.sum("w").alias("w"), *[F.struct(F.min(d), F.max(d)).alias(d) for d in DIMS]).collect()
    if not spread:
        return {}
    width, half = {}, {}
    if not whole:
        whole.update({d: max(1, spread[0][d][1] - spread[0][d][0]) for d in DIMS})
    for r in spread:
        wide = [((r[d][1] - r[d][0]) / whole[d], -i, d) for i, d in enumerate(DIMS)]
        width[r["node"]], half[r["node"]] = max(wide)[2], r["w"] / 2
    value = F.coalesce(*[F.when(_at_node({n: d == k for n, k in width.items()}, "boolean"), F.col(d)) for d in DIMS])
    at = points.withColumn("v", value).select("node", "v", "w", "tie")
    steps = defaultdict(list)
    for r in at.groupBy("node", "v").agg(F.sum("w").alias("w")).collect():
        steps[r["node"]].append((r["v"], r["w"]))
    cut, below = {}, {}
    for node, hist in steps.items():
        cut[node], below[node] = _median(sorted(hist), half[node], 0)
    low, span = {n: 0 for n in cut}, 1 << HASH_BITS
    chosen, held = {}, {}
    while span > 1:
        span = max(1, span // FINE)
        inside = at.where((F.col("v") == _at_node(cut, "int")) & (F.col("tie") >= _at_node(low, "long")) & (F.col("tie") - _at_node(low, "long") < span * FINE))
        bins = defaultdict(list)
        for r in inside.groupBy("node", ((F.col("tie") - _at_node(low, "long")) / span).cast("long").alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():
            bins[r["node"]].append((r["b"], r["w"], r["n"]))
        single = True
        for node, hist in bins.items():
            b, below[node] = _median(sorted((x[0], x[1]) for x in hist), half[node], below[node])
            low[node] += b * span
            chosen[node], held[node] = b, hist
            single &= next(x[2] for x in hist if x[0] == b) == 1
        if single:
            break
    # the range that holds the median goes to the side that it leaves closer to equal
    out = {}
    for node, start in low.items():
        weight = next((w for b, w, _ in held[node] if b == chosen[node]), 0)
        out[node] = (width[node], cut[node], start + span if below[node] + weight - half[node] < half[node] - below[node] else start)
    return out


def _median(hist: list[tuple[int, int]], half: float, below: int) -> tuple[int, int]:
    """(bin that holds the median, weight of all bins below it)."""
    for value, weight in hist:
        if below + weight >= half:
            return value, below
        below += weight
    return hist[-1][0], below - hist[-1][1]


def kd_tree(points: DataFrame, leaves: int) -> Space:
    """A tree of ``leaves`` leaves (a power of two) by recursive weighted-median splits of points
    (h, source, lang, size, w)."""
    levels = int(math.log2(leaves))
    if 1 << levels != leaves:
        raise ValueError("leaves must be a power of two")
    space, whole = Space(points), {}
    at = stored(space.steps(points).select(*DIMS, "tie", "w"), "kd-points")
    for _ in range(levels):
        cuts = _split_level(at.withColumn("node", space.leaf()), whole)
        if not cuts:
            break
        space.cuts.append(cuts)
    return space


def leaves_for(total_bytes: int, target_bytes: int) -> int:
    """The power of two of leaves that brings a leaf to the target size or under it."""
    return 1 << max(0, math.ceil(math.log2(max(1, total_bytes / target_bytes))))


def shard(docs: DataFrame, *, leaves: int | None = 16, target_bytes: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang, source, size, text_crc32, shard and slot.

    ``docs`` needs doc_id, text, lang and source; ``keep`` names columns to carry along (one
    that is named like a result becomes doc_<name>).  Give
    ``leaves``, or ``target_bytes`` and let the tree grow until a leaf reaches it.

    Rows are numbered within (shard, chunk), where the chunk is a hash of the row, and shifted by
    the rows of the shard's chunks before; there are as many chunks as the rows and their bytes need.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(
        "doc_id", "lang", "source", doc_size(F.col("text")).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept"),
    )
    sized = stored(every.drop("_kept"), "shard-sizes")
    if leaves is None:
        leaves = leaves_for(sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"], target_bytes)
    where = F.struct("source", "lang")
    points = sized.groupBy("h").agg(F.sum("size").alias("w"), F.max("size").alias("size"), F.min(where).alias("low"), F.max(where).alias("high"), F.count("*").alias("n"))
    points = stored(points.select("h", "w", "size", "n", "low.source", "low.lang", (~F.col("low").eqNullSafe(F.col("high"))).alias("spread")), "shard-points")
    space = kd_tree(points, leaves)
    moved = stored(points.where("spread").select("h", "n", F.struct("source", "lang").alias("at")), "shard-moved")
    total = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    chunks = max(1, -(-total["n"] // (leaves * CHUNK_ROWS)), -(-total["b"] // (leaves * CHUNK_BYTES)))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with shard and chunk; copies whose metadata differ take those of their group."""
        rows = lookup(rows, "h", moved, ["at"], n="n")
        own = F.struct(F.coalesce("at", F.struct("source", "lang")).alias("at_"), F.col("source").alias("s_"), F.col("lang").alias("l_")).alias("own")
        rows = rows.withColumn("own", own).withColumns({"source": F.col("own.at_.source"), "lang": F.col("own.at_.lang")})
        rows = space.steps(rows).withColumn("shard", space.leaf()).withColumns({"source": F.col("own.s_"), "lang": F.col("own.l_")})
        chunk = F.pmod(F.xxhash64("doc_id", "h", "source", "lang"), F.lit(chunks)).cast("int")
        return rows.withColumn("chunk", chunk).drop("own", "at", "tie", *DIMS)

    counts = placed(sized).groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(counts.select(F.col("shard").alias("s_"), F.col("chunk").alias("c_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shard-firsts")
    inner = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "source", "lang"))
    out = placed(every).withColumn("inner", inner).join(first, (F.col("shard") == F.col("s_")) & (F.col("chunk") == F.col("c_")))
    out = out.withColumn("slot", (F.col("first") + F.col("inner") - 1).cast("long"))
    own = ["doc_id", "lang", "source", "size", "text_crc32", "shard", "slot"]
    return out.select(*own, *[F.col(f"_kept.`{c}`").alias(f"doc_{c}" if c in own else c) for c in keep])
