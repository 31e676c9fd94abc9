"""Mixing sources to target weights: fixed-length blocks, drawn and joined by index.

DataFrame functions only.  The words of a source form one stream, cut into blocks of
``block_words``.  Every slot of the mixed corpus holds one block.

1. Every output shard draws multinomial counts of its sources: each of its slots picks a source
   by the targets' weights from an alias table, as a hash of the slot's number says; the counts by
   shard and source are all that is kept of the picks.
2. The counts are summed over the shards, so a source's slots are numbered through.  Draws miss
   the targets by about the root of their number: the slots of a source beyond its target go, in
   order, to the sources that are short of theirs.
3. Slot ``i`` of a source takes, in pass ``i div n_blocks``, the block that a keyed permutation of
   the block numbers gives for ``i mod n_blocks``: every block is taken once before any is taken
   again.  Blocks are joined with the documents by their number.

Nulls and odd input: a null text has no words and is never taken; null sources form one source,
ordered last; a source without words has target 0.  Repeated rows are separate documents with
the same id.  Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from sheaf.llm.common import fresh, stored, workers

SPACE = r"[\x20\x09-\x0D]+"
CHUNK = 4096
#: Slots of one output shard: about a million words in blocks of 64.
SHARD_SLOTS = 16_384


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reshare(sizes: list[int], weights: list[float], factor: float, cap: float) -> list[float]:
    """Targets by weight of ``factor`` times all sizes, none above ``cap`` times its own size.

    The excess of capped sources is shared among the others by weight until none is above.
    """
    total, capped = factor * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(cap * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free} if weight else {}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in capped else max(0.0, share[i]) for i in range(len(sizes))]
        capped |= over


def _permuted(df: DataFrame, index: str, n: str, keys: list[Column], rounds: int = 6) -> DataFrame:
    """Replace column ``index`` by a keyed permutation of 0..n-1 applied to it.

    Swap-or-not rounds: x and (key - x) mod n change places or not, as a hash of the larger says.
    It is a permutation for any n, and needs no table.
    """
    n, key = F.col(n), F.xxhash64(*keys)

    def one_round(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(F.greatest(x, other), key, r + 1000).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    # a fold over the rounds: chained projections would be inlined into one huge expression
    return df.withColumn(index, F.aggregate(F.array(*map(F.lit, range(rounds))), F.col(index), one_round))


def source_plan(sized: DataFrame, *, weights, factor: float, cap: float, block_words: int) -> list[dict]:
    """For each source, in order: no, source, source_size, target, n_blocks and slots.

    Only totals by source reach the driver.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["s"] or 0) for r in rows]
    targets = reshare(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], factor, cap)
    plan = []
    for no, (r, size, target) in enumerate(zip(rows, sizes, targets)):
        blocks = -(-size // block_words)
        slots = min(int(cap * blocks), round(target * blocks / size)) if size else 0
        plan.append({"no": no, "source": r["source"], "source_size": size, "target": float(target), "n_blocks": blocks, "slots": slots})
    return plan


def plan_table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    schema = "array<struct<no int, source string, source_size long, target double, n_blocks long, slots long, total long, first_moved long, first_short long>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), schema)).alias("p")).select("p.*")


def alias_table(slots: list[int]) -> tuple[list[int], list[int]]:
    """(keep, other): pick column c of len(slots) and v below sum(slots), both evenly; then c if
    v < keep[c], else other[c], comes up in proportion to ``slots``."""
    total, left = sum(slots), [s * len(slots) for s in slots]
    keep, other = [total] * len(slots), list(range(len(slots)))
    small, large = [i for i, x in enumerate(left) if x < total], [i for i, x in enumerate(left) if x >= total]
    while small and large:
        i, j = small.pop(), large[-1]
        keep[i], other[i] = left[i], j
        left[j] -= total - left[i]
        if left[j] < total:
            small.append(large.pop())
    return keep, other


def _of(values: list, kind: str) -> Column:
    """The entry of source number ``no``."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("no") + 1)


def draw_counts(spark: SparkSession, slots: list[int], *, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial draws: out_shard, no (of the source) and drawn."""
    keep, other = alias_table(slots)
    n = sum(slots)
    column = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(0)), F.lit(len(slots))).cast("int")
    ids = spark.range(0, n, 1, workers(spark)).select("id", column.alias("no"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(1)), F.lit(n)).alias("v"))
    picked = F.when(F.col("v") < _of(keep, "long"), F.col("no")).otherwise(_of(other, "int"))
    return ids.select(F.expr(f"id div {shard_slots}").alias("out_shard"), picked.alias("no")).groupBy("out_shard", "no").agg(F.count("*").alias("drawn"))


def draw_slots(spark: SparkSession, plan: list[dict], *, shard_slots: int, seed: int) -> DataFrame:
    """Every slot of the mix: source, block, out_shard, out_slot."""
    slots, n = [p["slots"] for p in plan], sum(p["slots"] for p in plan)
    if not n:
        return plan_table(spark, []).select("source", F.col("n_blocks").alias("block"), F.col("total").alias("out_shard"), F.col("total").alias("out_slot"))
    drawn = stored(draw_counts(spark, slots, shard_slots=shard_slots, seed=seed), "mix-draws")
    # running sums over the shards, in two levels
    part = drawn.withColumn("part", F.expr(f"out_shard div {CHUNK}"))
    sums = part.groupBy("no", "part").agg(F.sum("drawn").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("no").alias("k_no"), F.col("part").alias("k_part"), F.coalesce(F.sum("n").over(before("no").orderBy("part")), F.lit(0)).alias("start"))
    part = part.withColumn("inner", F.coalesce(F.sum("drawn").over(before("no", "part").orderBy("out_shard")), F.lit(0)))
    part = part.join(sums, (F.col("no") == F.col("k_no")) & (F.col("part") == F.col("k_part")))
    part = part.withColumn("ahead", F.coalesce(F.sum("drawn").over(before("out_shard").orderBy("no")), F.lit(0)))
    # a stated count: the rows are few before they are expanded, and would be coalesced into one task
    part = part.repartition(workers(spark), "no", "out_shard")
    each = part.withColumn("r", F.explode(F.expr("sequence(cast(0 as bigint), drawn - 1)")))
    each = each.select("no", "out_shard", (F.col("start") + F.col("inner") + F.col("r")).alias("i"), (F.col("ahead") + F.col("r")).alias("out_slot"))
    # the slots beyond a target, numbered, go to the sources that are short
    totals = {r["no"]: r["n"] for r in drawn.groupBy("no").agg(F.sum("drawn").alias("n")).collect()}
    moved = short = 0
    for p in plan:
        p["total"], p["first_moved"], p["first_short"] = totals.get(p["no"], 0), moved, short
        moved, short = moved + max(0, p["total"] - p["slots"]), short + max(0, p["slots"] - p["total"])
    beyond = F.col("i") >= _of(slots, "long")
    gaps = plan_table(spark, plan).where("total < slots").select(F.col("no").alias("to"), F.col("total"), F.col("first_short"), F.explode(F.expr("sequence(cast(0 as bigint), slots - total - 1)")).alias("q"))
    gaps = gaps.select("to", (F.col("total") + F.col("q")).alias("at"), (F.col("first_short") + F.col("q")).alias("e_"))
    over = each.where(beyond).withColumn("e", _of([p["first_moved"] for p in plan], "long") + F.col("i") - _of(slots, "long"))
    over = over.join(gaps, F.col("e") == F.col("e_")).select(F.col("to").alias("no"), "out_shard", F.col("at").alias("i"), "out_slot")
    every = each.where(~beyond).unionByName(over)
    every = every.withColumns({"n_blocks": _of([p["n_blocks"] for p in plan], "long"), "source": _of([p["source"] for p in plan], "string"), "n_slots": F.least(F.lit(shard_slots), F.lit(n) - F.col("out_shard") * shard_slots)})
    every = every.withColumns({"block": F.expr("i % n_blocks"), "pass": F.expr("i div n_blocks")})
    every = _permuted(every, "block", "n_blocks", [F.lit(seed), F.col("source"), F.col("pass")])
    return _permuted(every, "out_slot", "n_slots", [F.lit(seed + 1), F.col("out_shard")]).select("source", "block", "out_shard", "out_slot")


def stream_offsets(sized: DataFrame, *, bucket_rows: int = 50_000) -> DataFrame:
    """Add ``start``, the document's first word in its source's stream.

    A running sum in two levels: buckets by a hash of the id, then documents within a bucket, so
    that no source has to pass through one task.
    """
    buckets = max(64, -(-sized.count() // bucket_rows))
    df = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = df.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b_start", F.coalesce(F.sum("b_size").over(before), F.lit(0))).drop("b_size")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = df["source"].eqNullSafe(sums["source"]) & (df["bucket"] == sums["bucket"])
    return df.join(sums, same, "left").select(df["uid"], df["doc_id"], df["source"], df["size"], (F.col("inner") + F.col("b_start")).alias("start"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The parts of documents in blocks: first word within the document, and number of words."""
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return pieces.withColumns({"words": high - low, "word": low - F.col("start")})


def _drawn(docs: DataFrame, weights, factor: float, cap: float, block_words: int, shard_slots: int, seed: int):
    """(documents placed in their streams, source plan, slots, uses of each block)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("uid"))
    sized = stored(sized, "mix-sizes")
    plan = source_plan(sized, weights=weights, factor=factor, cap=cap, block_words=block_words)
    slots = draw_slots(docs.sparkSession, plan, shard_slots=shard_slots, seed=seed)
    # written before it is joined: its size can't be estimated from the few rows it is made of
    uses = stored(slots.groupBy("source", "block").agg(F.count("*").alias("uses")), "mix-uses")
    return stored(stream_offsets(sized), "mix-offsets"), plan, slots, uses


def mix(
    docs: DataFrame, *, weights=(3, 1, 2), factor: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_slots: int = SHARD_SLOTS, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(per-document counts, slots).

    The first has uid, doc_id, source, size, source_size, target and taken (the words that the mix
    takes of the document, repeats counted); the second is the mix itself as block references.
    ``docs`` needs doc_id, text and source.
    """
    placed, plan, slots, uses = _drawn(docs, weights, factor, cap, block_words, shard_slots, seed)
    pieces = _pieces(placed, block_words)
    same = pieces["source"].eqNullSafe(uses["source"]) & (pieces["block"] == uses["block"])
    taken = pieces.join(uses, same).groupBy(pieces["source"].alias("k_source"), F.col("start").alias("k_start")).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # (source, start) is unique among documents that have words
    on = placed["source"].eqNullSafe(taken["k_source"]) & (placed["start"] == taken["k_start"]) & (placed["size"] > 0)
    totals = plan_table(docs.sparkSession, plan).select(F.col("source").alias("p_source"), "source_size", "target")
    out = placed.join(taken, on, "left").join(totals, placed["source"].eqNullSafe(F.col("p_source")), "left")
    out = out.select(placed["uid"], placed["doc_id"], placed["source"], placed["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, slots


def mixed_documents(
    docs: DataFrame, *, weights=(3, 1, 2), factor: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_slots: int = SHARD_SLOTS, seed: int = 11,
) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: what each pass takes of a document is a row.

    A pass that takes all blocks of a document gives its text unchanged; one that takes some gives
    their words, in order, a space between them.  ``n_chars``, if there, follows the text.
    Repeated rows are separate documents, each with what the mix takes of its own place.
    """
    placed, _, _, uses = _drawn(docs, weights, factor, cap, block_words, shard_slots, seed)
    uid, copy, doc, key, nth, passed, size, took, parts = fresh(docs, "uid", "copy", "d_", "u_", "c_", "pass", "size", "took", "parts")
    rows = docs.withColumn(uid, F.xxhash64("text"))
    again = placed.groupBy("doc_id", "uid").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if again:
        # both sides number the copies by source first, so that a number means one source; the rest fixes which row gets it
        rest = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text", "source")]
        placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "uid").orderBy("source", "start")))
        rows = rows.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", uid).orderBy("source", *rest)))
    else:
        placed, rows = placed.withColumn("copy", F.lit(1)), rows.withColumn(copy, F.lit(1))
    pieces = _pieces(placed, block_words)
    same = pieces["source"].eqNullSafe(uses["source"]) & (pieces["block"] == uses["block"])
    used = pieces.join(uses, same).select("doc_id", "uid", "copy", "size", "word", "words", "uses")
    taken = used.withColumn(passed, F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))))
    taken = taken.groupBy(F.col("doc_id").alias(doc), F.col("uid").alias(key), F.col("copy").alias(nth), passed).agg(
        F.max("size").alias(size), F.sum("words").alias(took), F.array_sort(F.collect_list(F.struct("word", "words"))).alias(parts)
    )
    rows = rows.join(stored(taken, "mix-taken", free=True), rows["doc_id"].eqNullSafe(F.col(doc)) & (F.col(uid) == F.col(key)) & (F.col(copy) == F.col(nth)))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    # the words are bound once by a one-element array; named in the inner function, they would be split again for each part
    cut = lambda w: F.flatten(F.transform(parts, lambda p: F.slice(w, p["word"].cast("int") + 1, p["words"].cast("int"))))
    some = F.array_join(F.element_at(F.transform(F.array(words), cut), 1), " ")
    text = F.when(F.col(took) == F.col(size), F.col("text")).otherwise(some)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
