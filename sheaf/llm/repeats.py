"""Suffix-array dedup: repeated byte strings, from merged Burrows-Wheeler transforms.

Every 200-byte window of the corpus belongs to one *run*: the neighbouring windows that share
their least gram (the window's smallest hash of GRAM bytes, leftmost on ties).  Equal windows
have equal grams, so equal windows always lie in runs of the same gram, and the corpus splits
exactly by gram, whatever its size.

* A gram with one run has no repeats; that is told by counts of grams, without any text.
* The other runs, each distinct string once with the number of its occurrences, are gathered by
  gram.  Their strings are dealt to shards; each shard gets its suffix order and its transform; the
  transforms are merged by iterative interleave refinement: round h sorts all suffixes by h symbols
  by stably dealing the interleave by the preceding symbols.  The round in which a boundary appears
  is the common prefix; intervals without a boundary, of strings that occur more than once in
  all, are the repeats; suffixes are never sorted again together.
* Symbols are blocks of ``STEP`` bytes, read at every offset, so 200 bytes take 200 / STEP rounds.
* A gram with very many distinct runs is cut into pieces of PIECE window starts, gathered by the
  bytes that all windows of a piece share; equal windows still meet.  Equal pieces are one string.

Nulls and odd input: null and empty texts have no bytes; texts of under 200 bytes have no window;
ties of the gram go to the leftmost; periodic texts repeat themselves and are found within one
document; repeated rows and equal texts remove each other from 200 bytes on; long texts are hashed
in stretches that overlap by a window.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import lookup, stored, workers
from sheaf.llm.wordpos import SPAN, lean, prefix_sums, range_hash, row_groups

WINDOW, GRAM, STEP = 200, 40, 25
PIECE, MANY = 16, 2_000
_AT = np.uint64(23)


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in raws], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    return np.frombuffer(b"\0".join(raws) + bytes(WINDOW + 1), np.uint8), begin, size


def _least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` hashes, where its least one stands (leftmost on ties).

    A place takes the low bits, so there may be no more hashes than those can tell apart; all calls
    order the hashes by the same high bits.
    """
    if len(h) >> int(_AT):
        raise ValueError("too many hashes at once")
    least, width = (h >> _AT << _AT) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (least & np.uint64((1 << int(_AT)) - 1)).astype(np.int64)


def runs(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, gram hash, run digest, first window, windows, gram's place in the run)."""
    raw, begin, size = _joined(raws)
    at = np.arange(len(raw) - GRAM + 1)
    sums = prefix_sums(raw)
    h = range_hash(sums, at, at + GRAM)
    place = _least_places(h, WINDOW - GRAM + 1)
    count = np.maximum(0, size - WINDOW + 1)
    doc = np.repeat(np.arange(len(raws)), count)
    window = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    chosen = place[window]
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    start, many = window[new], np.diff(np.append(new, len(window)))
    return doc[new], h[chosen[new]].view(np.int64), range_hash(sums, start, start + many + WINDOW - 1).view(np.int64), start - begin[doc[new]], many, chosen[new] - start


def _stretches(texts: list[str | None], most: int = SPAN):
    """Groups of (text number, offset, bytes): texts in stretches of ``most`` window starts."""
    held, size = [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - WINDOW + 1), most):
            part = raw[at : at + most + WINDOW - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


RUNS = "uid long, v int, h long, c long, s int, n int, o int"


def _run_batches(batches):
    for batch in (part for whole in batches for part in row_groups(whole)):
        uid, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("uid", "v"))
        for held in _stretches(batch.column("text").to_pylist()):
            part, h, c, s, n, o = runs([raw for _, _, raw in held])
            doc, at = np.array([i for i, _, _ in held])[part], np.array([a for _, a, _ in held])[part]
            yield pa.RecordBatch.from_arrays([pa.array(uid[doc]), pa.array(v[doc]), pa.array(h), pa.array(c), *[pa.array(x.astype(np.int32)) for x in (s + at, n, o)]], ["uid", "v", "h", "c", "s", "n", "o"])


# --- transforms -------------------------------------------------------------------------------


def _suffixes(raws: list[bytes], step: int):
    """Elements of all strings: symbols, successors and predecessors' symbols.

    An element is a block of ``step`` bytes at some offset; its successor stands ``step`` bytes
    further.  Each string has ``step`` chains, each closed by an end element (symbol 0).
    """
    size = np.array([len(r) for r in raws], np.int64)
    raw, first = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(size) - size
    blocks = size - step + 1
    base = np.cumsum(blocks + step) - blocks - step  # elements of a string: its blocks, then its ends
    owner = np.repeat(np.arange(len(raws)), blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[owner] + inner
    digest = range_hash(prefix_sums(raw), start, start + step)
    total = int((blocks + step).sum())
    symbol, after, string = np.zeros(total, np.int32), np.arange(total), np.repeat(np.arange(len(raws)), blocks + step)
    element = base[owner] + inner
    symbol[element] = np.unique(digest, return_inverse=True)[1] + 1
    further = inner + step
    closes = further >= blocks[owner]
    after[element] = np.where(closes, base[owner] + blocks[owner] + inner % step, base[owner] + further)
    before = np.zeros(total, np.int32)
    before[after[element]] = symbol[element]
    return symbol, after, before, string, element, owner, inner


def _order(symbol: np.ndarray, after: np.ndarray, rounds: int) -> np.ndarray:
    """Suffix order of one shard to a depth of at least ``rounds`` symbols, by prefix doubling."""
    rank, depth = symbol.astype(np.int64), 1
    while depth < rounds:
        top = int(rank.max()) + 1
        rank = np.unique(rank * top + rank[after], return_inverse=True)[1]
        if int(rank.max()) + 1 == len(rank):
            break
        after, depth = after[after], depth * 2
    return np.argsort(rank, kind="stable")


def _stable(c: np.ndarray) -> np.ndarray:
    """Stable order by symbol: one or two radix passes of 16 bits."""
    perm = np.argsort(c.astype(np.uint16), kind="stable")
    if len(c) and int(c.max()) > 0xFFFF:
        perm = perm[np.argsort((c >> 16).astype(np.uint16)[perm], kind="stable")]
    return perm


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms, and common prefixes.

    Returns (shard of each suffix in merged order, lcp): lcp[i] is the common prefix of suffixes
    i-1 and i in symbols, ``rounds`` where it is at least that.
    """
    turn = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint8)
    group, lcp = np.zeros(len(turn), np.int32), np.full(len(turn), rounds, np.int32)
    if len(lcp):
        lcp[0] = 0
    for h in range(rounds):
        c = np.empty(len(turn), np.int32)
        for j, t in enumerate(transforms):
            c[turn == j] = t
        perm = _stable(c)
        turn, c, group = turn[perm], c[perm], group[perm]
        ends = int(np.searchsorted(c, 1))
        turn[:ends].sort()  # ends are all alike: they keep the shards' order
        new = np.zeros(len(turn), bool)
        new[1:] = (c[1:] != c[:-1]) | ((group[1:] != group[:-1]) & (c[1:] != 0))
        lcp[new & (lcp == rounds)] = h
        group = np.cumsum(new, dtype=np.int32)
    return turn, lcp


def repeated_windows(raws: list[bytes], *, times: list[int] | None = None, window: int = WINDOW, step: int = STEP, shards: int = 3) -> list[np.ndarray]:
    """For each string, which of its windows occur at two places of the strings at least.

    ``times`` has how often each string stands in the corpus, once by default.
    """
    rounds = window // step
    if rounds * step != window:
        raise ValueError("step must divide window")
    out = [np.zeros(max(0, len(r) - window + 1), bool) for r in raws]
    long = [i for i, r in enumerate(raws) if len(r) >= window]
    if not long:
        return out
    held = [raws[i] for i in long]
    symbol, after, before, string, element, owner, inner = _suffixes(held, step)
    orders, transforms = [], []
    for part in np.array_split(np.arange(len(held)), min(shards, len(held))):
        low, high = np.searchsorted(string, part[0]), np.searchsorted(string, part[-1] + 1)
        order = _order(symbol[low:high], after[low:high] - low, rounds) + low
        orders.append(order)
        transforms.append(before[order])
    turn, lcp = merge(transforms, rounds)
    interval = np.cumsum(lcp < rounds)
    group = np.empty(len(symbol), np.int64)
    for j, order in enumerate(orders):
        group[order] = interval[turn == j]
    size = np.array([len(r) for r in held], np.int64)
    starts = inner <= size[owner] - window
    own = group[element[starts]]
    weight = np.ones(len(raws)) if times is None else np.array(times, np.float64)
    many = np.bincount(own, weight[long][owner[starts]], minlength=int(interval[-1]) + 1)[own] > 1
    for i, part in zip(long, np.split(many, np.cumsum(size - window + 1)[:-1])):
        out[i] = part
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


FOUND = "h long, c long, times long, low int, high int"


def _repeat_batches(most: int):
    def work(rows):
        found = repeated_windows([r[5] for r in rows], times=[r[3] for r in rows])
        hits = [(h, c, t, at + a, at + b) for (_, h, c, t, at, _), flags in zip(rows, found) for a, b in _spans(flags)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in hits], k) for i, k in enumerate(kinds)], ["h", "c", "times", "low", "high"])

    def run(batches):
        rows, size = [], 0  # whole groups only; rows come sorted by g
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("g", "h", "c", "times", "at", "body"))):
                if size >= most and row[0] != rows[-1][0]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield work(rows)

    return run


CUT = "g long, h long, c long, times long, at int, body binary, d long"


def _cut_batches(batches):
    for batch in (part for whole in batches for part in row_groups(whole)):
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for cut in cuts:
                h, c, t, s, n, o = (cut[k] for k in ("h", "c", "times", "s", "n", "o"))
                if not cut["many"]:
                    rows.append((h, h, c, t, 0, raw[s : s + n + WINDOW - 1], None))
                    continue
                # pieces of window starts with the same place relative to the gram, so that equal windows share a piece
                lead = (WINDOW - GRAM - o) % PIECE
                low = 0
                while low < n:
                    high = min(n, low + PIECE - (lead + low) % PIECE)
                    whole = low - (lead + low) % PIECE  # where the full piece would start
                    core = raw[s + whole + PIECE - 1 : s + whole + WINDOW]
                    key = int.from_bytes(hashlib.blake2b(core + h.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                    body = raw[s + low : s + high + WINDOW - 1]
                    rows.append((key, h, c, t, low, body, int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)))
                    low = high
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 20_000]], k) for i, k in enumerate(kinds)], ["g", "h", "c", "times", "at", "body", "d"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, end long>>"


def _remove(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in (part for whole in batches for part in row_groups(whole)):
        cols: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for p in sorted((p["a"], p["b"]) for p in spans or ()):
                if merged and p[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], p[1])
                else:
                    merged.append([*p])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            row = (len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "end": b} for a, b in merged])
            for col, v in zip(cols, row):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _merged(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """FOUND rows of strings (g, h, c, times, at, body), gathered by g."""
    return rows.repartition(workers(rows.sparkSession), "g").sortWithinPartitions("g").mapInArrow(lean(_repeat_batches(chunk_bytes)), FOUND)


def remove_repeats(docs: DataFrame, *, chunk_bytes: int = 30_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans.

    Rows are told apart by 96 bits of hashes of id and text; rows that are equal in both get
    equal spans, as they should.
    """
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"), F.hash("doc_id", "text").alias("v"))
    every = stored(base.select("uid", "v", "text").mapInArrow(lean(_run_batches), RUNS), "repeat-runs")
    grams = stored(every.groupBy("h").agg(F.count("*").alias("seen")).where("seen > 1"), "repeat-grams")
    shared = stored(lookup(every, "h", grams, ["seen"], "inner", n="seen").drop("seen"), "repeat-shared")
    del every, grams
    distinct = shared.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("uid", "v", "s", "n", "o")).alias("r"))
    distinct = stored(distinct, "repeat-distinct", free=True)
    crowded = stored(distinct.groupBy("h").agg(F.count("*").alias("variants")).where(F.col("variants") > MANY), "repeat-crowded")
    cuts = lookup(distinct, "h", crowded, ["variants"], n="variants")
    cuts = cuts.select("r.uid", "r.v", F.struct("h", "c", "times", "r.s", "r.n", "r.o", F.col("variants").isNotNull().alias("many")).alias("cut"))
    cuts = cuts.groupBy(F.col("uid").alias("u_"), F.col("v").alias("v_")).agg(F.collect_list("cut").alias("cuts"))
    mine = (F.col("uid") == F.col("u_")) & (F.col("v") == F.col("v_"))
    bodies = base.join(cuts, mine).dropDuplicates(["uid", "v"]).select("text", "cuts").mapInArrow(lean(_cut_batches), CUT)
    bodies = stored(bodies, "repeat-bodies", free=True)
    found = _merged(bodies.where("d is null").select("g", "h", "c", "times", "at", "body"), chunk_bytes)
    if crowded.limit(1).count():
        # equal pieces of different runs are one string, and what is found in it holds for each
        pieces = bodies.where("d is not null")
        one = pieces.groupBy("g", "d").agg(F.sum("times").alias("times"), F.count("*").alias("n"), F.min("body").alias("body"))
        one = stored(one, "repeat-pieces")
        inside = _merged(one.select("g", F.col("g").alias("h"), F.col("d").alias("c"), "times", F.lit(0).alias("at"), "body"), chunk_bytes)
        inside = stored(inside.groupBy("h", "c").agg(F.collect_list(F.struct("low", "high")).alias("parts")), "repeat-inside")
        inside = inside.select(F.col("h").alias("g"), F.col("c").alias("d"), "parts").join(one.select("g", "d", "n"), ["g", "d"])
        each = lookup(pieces.drop("body"), ["g", "d"], stored(inside, "repeat-parts"), ["parts"], "inner", n="n")
        each = each.select("h", "c", "times", "at", F.explode("parts").alias("p")).select("h", "c", "times", (F.col("at") + F.col("p.low")).alias("low"), (F.col("at") + F.col("p.high")).alias("high"))
        found = found.unionByName(each)
    found = found.groupBy("h", "c").agg(F.max("times").alias("times"), F.collect_list(F.struct("low", "high")).alias("parts"))
    found = stored(found, "repeat-found", free=True)
    del bodies
    places = lookup(shared, ["h", "c"], found, ["parts"], "inner", n="times")
    moved = F.transform("parts", lambda p: F.struct((F.col("s") + p["low"]).cast("long").alias("a"), (F.col("s") + p["high"] + WINDOW - 1).cast("long").alias("b")))
    spans = places.groupBy(F.col("uid").alias("u_"), F.col("v").alias("v_")).agg(F.flatten(F.collect_list(moved)).alias("spans"))
    spans = stored(spans, "repeat-spans", free=True)
    return base.join(spans, mine, "left").select("doc_id", "text", "spans").mapInArrow(lean(_remove), OUT)
