"""MinHash near-duplicates: one-permutation hashing, bands and star-shaped candidate edges.

1. Each document's distinct five-word shingles are hashed; documents with equal sets are one class.
2. One permutation: a shingle falls into one of a number of bins, each bin keeps its smallest
   hash, and empty bins borrow from filled bins in an order that two-universal hashing fixes
   (optimal densification).  Groups of ``ROWS`` bins are bucket keys; ``bands_for`` gives how many.
3. Within a bucket every class is paired with the smallest one only (a star), and the pairs are
   confirmed on full sets.  Confirmed pairs give the first components.
4. A star loses pairs of leaves.  So the members of stars of which a link failed between two
   components are searched again, exactly: sets that are similar share one of their rarest shingles
   (a prefix filter).  Of a group those outside its largest component are compared in blocks with
   the others; only links that join components are emitted.  No bucket or group is capped.

At the threshold a pair shares no bucket with a chance of about 1e-5, and less above.

Nulls and odd input: null and empty texts have empty sets, are linked with nothing and kept; with
fewer than five words the whole sequence is the one shingle; equal texts and repeated rows are in
one class; very long texts are hashed whole.  Rows with a null id are linked with nothing: their
component is null and they are kept.  Rows that share an id are one document: links are found
for each text, and confirmed on the smallest text of the id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import lookup, stored, workers
from sheaf.llm.components import components
from sheaf.llm.wordpos import SPACES, groups_of, joined, lean, mix, row_groups, word_hashes, words

WIDTH = 5
ROWS, MISSED = 8, 1e-5
STEP = np.uint64(0xD6E8FEB86659FD93)


def bands_for(percent: int) -> int:
    """Bands that miss a pair at the threshold with a chance of about MISSED: 36 at 85, 63 at 80."""
    return max(1, round(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def least_for(percent: int) -> int | None:
    """With fewer distinct shingles than this only equal sets reach the threshold: 6 at 85, 4 at 80."""
    return -(-percent // (100 - percent)) if percent < 100 else None


BINS = ROWS * bands_for(85)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in groups_of(texts):
        raw, begin = joined(texts[part])
        start, end = words(raw, SPACES)
        w = word_hashes(raw, start, end)
        first = np.searchsorted(start, begin)
        h = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            h = h * STEP + w[j : j + len(h)]
        h = mix(h)
        for i in range(len(begin) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= WIDTH:
                out.append(np.unique(h[a : b - WIDTH + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in w[a:b]:
                        whole = whole * STEP + x
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _donors(seed: int = 41, tries: int = 2048, bins: int = BINS) -> np.ndarray:
    """For every bin, the bins that it asks in turn when it is empty."""
    return np.random.default_rng(seed).integers(0, bins, (tries, bins))


def signatures(sets: list[np.ndarray], donors: np.ndarray) -> np.ndarray:
    """One row of values, one a bin, for each (non-empty) set."""
    bins = donors.shape[1]
    sizes = np.array([len(s) for s in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    slot = row * bins + ((every >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    new = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted, so a bin's first value is its least
    values, filled = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    values[slot[new]], filled[slot[new]] = every[new], True
    empty = np.flatnonzero(~filled)
    for asked in donors:
        if not len(empty):
            break
        donor = empty - empty % bins + asked[empty % bins]
        found = filled[donor]
        values[empty[found]] = values[donor[found]]
        empty = empty[~found]
    for at in empty:  # not reached within the table: the set's smallest hash
        values[at] = sets[at // bins][0]
    return values.reshape(len(sets), bins)


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.shape[1] // ROWS
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    cut = sig.reshape(len(sig), bands, ROWS)
    for r in range(ROWS):
        h = h * STEP + cut[:, :, r]
    return mix(h).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def _sign(percent: int):
    bins, least = ROWS * bands_for(percent), least_for(percent)

    def run(batches):
        donors = _donors(bins=bins)
        for batch in batches:
            for rows in row_groups(batch):
                sets = shingle_sets(rows.column("text").to_pylist())
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                wide = [i for i, s in enumerate(sets) if least and len(s) >= least]
                keys: list = [[]] * len(sets)
                if wide:
                    for i, k in zip(wide, band_keys(signatures([sets[i] for i in wide], donors))):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    return run


def similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _stars(percent: int):
    """Rows sorted by (u, salt, role): the centre first, then its members, one at a time."""

    def run(batches):
        at, centre = None, np.zeros(0, np.uint64)
        for batch in (part for whole in batches for part in row_groups(whole)):
            sets = shingle_sets(batch.column("text").to_pylist())
            out = []
            for u, salt, role, d, s in zip(*(batch.column(c).to_pylist() for c in ("u", "salt", "role", "id")), sets):
                if role == 0:
                    at, centre = (u, salt), s
                elif at == (u, salt) and len(s) and len(centre):
                    small, large = (s, centre) if len(s) < len(centre) else (centre, s)
                    place = np.searchsorted(large, small)
                    place[place == len(large)] = 0
                    if similar(int((large[place] == small).sum()), len(s), len(centre), percent):
                        out.append((u, d))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return run


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(workers(rows.sparkSession), *keys).sortWithinPartitions(*keys, "role", "id")


def confirm_stars(edges: DataFrame, texts: DataFrame, percent: int, members: int = 256, share: int = 256) -> DataFrame:
    """Edges (u, v) whose full sets are similar enough.

    A centre's text is sent once for each ``members`` of its members, so that no task gets a whole
    star, and a task holds one centre at a time.  Centres are multiplied in two steps, before and
    after they meet their texts, so that no task has to write all copies of one.
    """
    salts = stored(edges.groupBy("u").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / members).cast("int")), "near-salts")
    leaf = lookup(edges, "u", salts, ["salts"], "inner", n="n").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("low"), F.lit(0).alias("more"), F.lit(1).alias("role"), F.col("v").alias("id"))
    hub = salts.withColumn("low", F.explode(F.expr(f"sequence(0, salts - 1, {share})")))
    hub = hub.select("u", "low", F.least(F.lit(share), F.col("salts") - F.col("low")).cast("int").alias("more"), F.lit(0).alias("role"), F.col("u").alias("id"))
    rows = leaf.unionByName(hub).join(texts.withColumnRenamed("doc_id", "id"), "id")
    rows = rows.select("u", "role", "id", "text", F.explode(F.expr("sequence(low, low + greatest(more, 1) - 1)")).alias("salt"))
    return _dealt(rows, ["u", "salt"]).mapInArrow(lean(_stars(percent)), "u long, v long")


def _spread(batches):
    """A row for each shingle of a document."""
    for batch in (part for whole in batches for part in row_groups(whole)):
        sets = shingle_sets(batch.column("text").to_pylist())
        n = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), n)
        ids, comps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp"))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(comps[row]), pa.array(n[row]), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "comp", "n", "h"])


def prefixes(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(h, id, comp, n, m): the shingles of each node of which a similar node must have one.

    A set's shingles are ordered by the number of nodes that have them.  Similar sets share one of
    the first n - ceil(n * percent / 100) + 1, and one that no other node has is no use; ``m``
    shingles stand in other nodes, too.
    """
    spread = nodes.join(texts.withColumnRenamed("doc_id", "id"), "id").mapInArrow(lean(_spread), "id long, comp long, n long, h long")
    spread = stored(spread, "near-spread")
    seen = stored(spread.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-seen")
    ranked = lookup(spread, "h", seen, ["df"], "inner", n="df").groupBy("id").agg(
        F.first("comp").alias("comp"), F.first("n").alias("n"), F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared")
    )
    first = F.expr(f"cast(greatest(0, n - ({percent} * n + 99) div 100 + 1 - (n - m)) as int)")
    return ranked.select("id", "comp", "n", "m", F.explode(F.slice("shared", 1, first)).alias("s")).select("s.h", "id", "comp", "n", "m")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of shingles that nodes of several components have."""
    keys = rows.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    return lookup(rows, "h", keys, ["low"], "inner", n="size").drop("low")


class _Joined:
    """Union-find over the component labels that one block sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Block:
    """The documents of one block, with an index from shingle to those that have it."""

    def __init__(self):
        self.comps, self.sets, self.index = [], [], None

    def add(self, comp: int, s: np.ndarray):
        self.comps.append(comp)
        self.sets.append(s)

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        if self.index is None:
            every = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            order = np.argsort(every, kind="stable")
            self.keys, at = np.unique(every[order], return_index=True)
            self.edges, self.owner = np.append(at, len(every)), owner[order].astype(np.int32)
            self.sizes, self.index = np.array([len(x) for x in self.sets]), True
        place = np.searchsorted(self.keys, s)
        place[place == len(self.keys)] = 0
        hit = place[self.keys[place] == s] if len(self.keys) else place[:0]
        low, n = self.edges[hit], self.edges[hit + 1] - self.edges[hit]
        take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[take], minlength=len(self.sets))


def _blocks(percent: int):
    """Rows sorted by (g, salt, part, role): a block's documents first, then a part of the group."""

    def run(batches):
        at, block, seen = None, _Block(), _Joined()
        for batch in (part for whole in batches for part in row_groups(whole)):
            sets = shingle_sets(batch.column("text").to_pylist())
            out = []
            for g, salt, part, role, comp, s in zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "part", "role", "comp")), sets):
                if at != (g, salt, part):
                    at, block, seen = (g, salt, part), _Block(), _Joined()
                if role == 0:
                    block.add(comp, s)
                elif block.sets:
                    inter = block.overlaps(s)
                    for i in np.flatnonzero(similar(inter, block.sizes, len(s), percent)).tolist():
                        if seen.join(block.comps[i], comp):
                            out.append((block.comps[i], comp))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return run


def residual_links(nodes: DataFrame, texts: DataFrame, percent: int, least: int = 128, most: int = 2048) -> DataFrame:
    """Links (u, v) between components that the stars did not test; ``nodes`` has id, comp and g.

    Only nodes that share a prefix shingle with a node of another component are compared.  Within a
    group those outside its largest component are cut into blocks, and all of it into parts, of
    ``least`` to ``most`` nodes (a 64th of the group between); each block meets each part, in a
    task that indexes the block and emits joining links only.
    """
    able = _open(stored(prefixes(nodes.select("id", "comp"), texts, percent), "near-ranked"))
    small = able.groupBy("h").agg(F.min("n").alias("small"), F.count("*").alias("size"))
    able = lookup(able, "h", stored(small, "near-small"), ["small"], "inner", n="size").where((100 + percent) * F.col("m") >= percent * (F.col("n") + F.col("small")))
    able = stored(able.select("id").distinct().withColumn("able", F.lit(True)), "near-able", free=True)
    nodes = stored(lookup(nodes, "id", able, ["able"], "inner").select("id", "comp", "g"), "near-nodes")
    sizes = nodes.groupBy("g", "comp").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    side = F.least(F.lit(most), F.greatest(F.lit(least), F.expr("all div 64")))
    groups = groups.withColumns({"salts": F.ceil((F.col("all") - F.col("most")) / side).cast("int"), "parts": F.ceil(F.col("all") / side).cast("int")})
    inside = stored(lookup(nodes, "g", stored(groups, "near-groups"), ["major", "salts", "parts"], "inner", n="all"), "near-inside")
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    mine = inside.where("comp <> major").select("g", dealt("salts", 1).alias("salt"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("role"), "id", "comp")
    every = inside.select("g", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), dealt("parts", 2).alias("part"), F.lit(1).alias("role"), "id", "comp")
    rows = mine.unionByName(every).join(texts.withColumnRenamed("doc_id", "id"), "id").select("g", "salt", "part", "role", "id", "comp", "text")
    return _dealt(rows, ["g", "salt", "part"]).mapInArrow(lean(_blocks(percent)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    """
    signed = docs.select("doc_id", "text").mapInArrow(lean(_sign(percent)), SIGNED)
    signed = stored(signed.withColumn("set_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id"))), "near-signed")
    classes = signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    known = lookup(signed, "set_id", stored(classes, "near-sets"), ["rep"], n="n")
    known = stored(known.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("doc_id") == F.coalesce("rep", "doc_id"), F.col("bands")).alias("bands")), "near-classes")
    keyed = known.select("doc_id", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("top"), F.count("*").alias("n")).where("u < top")
    edges = lookup(keyed, "key", stored(stars, "near-stars"), ["u"], "inner", n="n").where("doc_id <> u")
    edges = stored(edges.select("u", F.col("doc_id").alias("v")).distinct(), "near-edges", free=True)
    wanted = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    # the ids grow with the corpus, so they are merged with it at every size, never broadcast
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = stored(texts, "near-texts")
    links = stored(confirm_stars(edges, texts, percent), "near-links", free=True)
    first = stored(components(links), "near-first")

    def label(rows: DataFrame, col: str, to: str, marks: DataFrame) -> DataFrame:
        marks = marks.select(F.col("id").alias(col), F.col("component").alias("_c"))
        return lookup(rows, col, marks, ["_c"]).withColumn(to, F.coalesce("_c", col)).drop("_c")

    pairs = stored(label(label(edges, "u", "cu", first), "v", "cv", first), "near-pairs")
    failed = pairs.where("cu <> cv").groupBy("u").agg(F.lit(True).alias("failed"))
    open_ = lookup(pairs, "u", stored(failed, "near-failed"), ["failed"], "inner")
    nodes = stored(open_.select(F.col("u").alias("id"), F.col("cu").alias("comp")).union(open_.select("v", "cv")).distinct(), "near-open")
    final = label(known.select("doc_id", "n_shingles", "rep"), "rep", "component_id", first)
    if nodes.limit(1).count():
        between = pairs.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        groups = stored(components(between).withColumnRenamed("id", "comp"), "near-between")
        nodes = lookup(nodes, "comp", groups, ["component"], "inner").withColumnRenamed("component", "g")
        more = stored(components(stored(residual_links(nodes, texts, percent), "near-residual", free=True)), "near-more", free=True)
        final = label(final.withColumnRenamed("component_id", "comp"), "comp", "component_id", more)
    return final.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest id stays.

    Rows without an id cannot be told apart and stay; of rows that share an id one stays.
    """
    gone = near_duplicates(docs, percent=percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = stored(gone, "near-gone", free=True)
    left = docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"])) if again else left
