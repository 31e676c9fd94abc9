"""Benchmark decontamination with a positional inverted index, sharded by document.

``build_index`` stores, for every training document, the postings (positions) of its terms.  Terms
that the benchmark cannot have are left out by a bitmap of fixed size, in which every term of the
whole benchmark sets a bit; so the index does not depend on how the benchmark is taken later.
``phrase_hits`` intersects the offset-adjusted postings of each benchmark window term by term, from
the one that is rarest in the corpus: a start survives while every further term has the posting
that the phrase needs.  ``proximity_hits`` finds windows whose terms all stand near an occurrence
of the rarest one, in any order and with words between.

The benchmark's windows are a stated query set; they are taken in blocks of bounded size, each
shipped to all tasks, so no part of the benchmark or of the corpus is ever joined or collected
whole.  An item longer than a block is cut into pieces that overlap by a window less a word.

Nulls and odd input: null texts and texts without words have no words and no hits; an item
without words has no window; repeated items share their windows and are all reported; repeated
documents are judged alike; null item ids are ignored; ids of items and documents may have any
type.  Very long texts are indexed whole.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import stored
from sheaf.llm.wordpos import SIGNS, groups_of, joined, lean, row_groups, word_hashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WINDOW, WITHIN = 13, 20
#: Words of one block of the benchmark; a block is what one task holds of it.
BLOCK_WORDS = 200_000
#: Bits of the bitmap of benchmark terms (2 MiB).
BITS = 24


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


class Queries:
    """The windows of a block of items: terms by their hashes, windows by length, and their items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        raw, begin = joined([t for _, t in items])
        start, end = words(raw, SIGNS)
        self.terms, ids = np.unique(word_hashes(raw, start, end), return_inverse=True)
        first = np.searchsorted(start, begin)
        found, owners = defaultdict(list), defaultdict(list)
        for (name, _), a, b in zip(items, first, first[1:]):
            if b > a:
                n = min(size, int(b - a))
                view = np.lib.stride_tricks.sliding_window_view(ids[a:b], n)
                found[n].append(view)
                owners[n].append(np.full(len(view), number[name]))
        self.windows, self.first, item_of = {}, {}, []
        total = 0
        for n in sorted(found):
            rows, at = np.unique(np.concatenate(found[n]), axis=0, return_inverse=True)
            self.windows[n], self.first[n] = rows.astype(np.int32), total
            item_of.append(np.column_stack([at.reshape(-1) + total, np.concatenate(owners[n])]))
            total += len(rows)
        pairs = np.unique(np.concatenate([*item_of, np.zeros((0, 2), np.int64)]), axis=0)
        self.edges, self.items = np.searchsorted(pairs[:, 0], np.arange(total + 1)), pairs[:, 1].astype(np.int32)

    def plan(self, frequency: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By window length: (first window number, terms, offsets), both ordered from the rarest term."""
        out = []
        for n, rows in self.windows.items():
            order = np.argsort(frequency[rows], axis=1, kind="stable")
            out.append((self.first[n], np.take_along_axis(rows, order, 1), order.astype(np.int32)))
        return out

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Names of the items that have one of the windows."""
        return [self.names[i] for i in sorted({i for w in np.unique(windows).tolist() for i in self.items[self.edges[w] : self.edges[w + 1]].tolist()})]


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """Items (id as text, text) in blocks of about ``most`` words, one block on the driver at a time."""
    held, n = [], 0
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text")
    for r in rows.toLocalIterator():
        text = r["text"] or ""
        parts = [text]
        if len(text) > 2 * most:
            every = tokens(text)
            parts = [" ".join(every[at : at + most + WINDOW - 1]) for at in range(0, max(1, len(every) - WINDOW + 1), most)]
        for part in parts:
            held.append((r["i"], part))
            n += len(part) // 4 + 1
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _marks(batches):
    """Words of the bitmap (64 bits each) that the terms of some texts set."""
    low = np.uint64(63)
    for batch in (part for whole in batches for part in row_groups(whole)):
        raw, _ = joined(batch.column("text").to_pylist())
        bit = np.unique(word_hashes(raw, *words(raw, SIGNS)) >> np.uint64(64 - BITS))
        at, new = np.unique(bit >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & low), new) if len(bit) else bit
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])


def term_bitmap(benchmark: DataFrame) -> np.ndarray:
    """A bit for each possible value of the first BITS bits of a term's hash."""
    out = np.zeros(1 << BITS - 6, np.uint64)
    rows = benchmark.where("item_id is not null").select("text").mapInArrow(lean(_marks), "at long, bits long")
    for r in rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["at"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def _index(bitmap: np.ndarray):
    def run(batches):
        for batch in (part for whole in batches for part in row_groups(whole)):
            texts = batch.column("text").to_pylist()
            for part in groups_of(texts):
                raw, begin = joined(texts[part])
                start, end = words(raw, SIGNS)
                h = word_hashes(raw, start, end)
                bit = h >> np.uint64(64 - BITS)
                keep = np.flatnonzero(bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                first = np.searchsorted(start, begin)  # first word of each document
                doc = np.repeat(np.arange(len(begin) - 1), np.diff(first))
                place = keep[np.lexsort((keep, h[keep], doc[keep]))]
                new = np.flatnonzero((np.diff(doc[place], prepend=-1) != 0) | (np.diff(h[place], prepend=np.uint64(0)) != 0) | (np.arange(len(place)) == 0))
                sizes, heads = np.diff(np.append(new, len(place))).astype("<i4"), h[place[new]].astype("<u8")
                pos = (place - first[doc[place]]).astype("<i4")
                by_doc, by_post = np.searchsorted(doc[place[new]], np.arange(len(begin))), np.searchsorted(doc[place], np.arange(len(begin)))
                cut = lambda a, b: pa.array([a[b[i] : b[i + 1]].tobytes() for i in range(len(b) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "uid")], pa.array(np.diff(first).astype(np.int64)), cut(heads, by_doc), cut(sizes, by_doc), cut(pos, by_post),
                ], ["doc_id", "uid", "n_words", "terms", "counts", "positions"])

    return run


def _schema(docs: DataFrame, rest: str) -> T.StructType:
    """The document's id, whatever its type, and further columns."""
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(rest).fields])


def build_index(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Store the postings of every document: its terms' hashes, how often each stands, and where."""
    schema = _schema(docs, "uid long, n_words long, terms binary, counts binary, positions binary")
    return stored(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text").mapInArrow(lean(_index(bitmap)), schema), "postings", free=True)


def _ranks(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Numbers of hashes among a block's terms, -1 for others."""
    if not len(terms):
        return np.full(len(h), -1)
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    return np.where(terms[at] == h, at, -1)


def _frequencies(terms: np.ndarray):
    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in _chunks(batch):
                at = _ranks(np.frombuffer(b"".join(part.column("terms").to_pylist()), "<u8"), terms)
                counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i4")
                total += np.bincount(at[at >= 0], counts[at >= 0], minlength=len(terms)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    return run


def term_frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """How often each term of a block stands in the whole corpus."""
    out = np.zeros(len(queries.terms), np.int64)
    counts = index.select("terms", "counts", "positions").mapInArrow(lean(_frequencies(queries.terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counts.toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def _postings(batch, known: np.ndarray):
    """(sorted keys of all postings of known terms, first and last posting of each term, document offsets)."""
    rows = batch.num_rows
    terms = [np.frombuffer(t, "<u8") for t in batch.column("terms").to_pylist()]
    counts = [np.frombuffer(c, "<i4") for c in batch.column("counts").to_pylist()]
    places = [np.frombuffer(p, "<i4") for p in batch.column("positions").to_pylist()]
    n_words = batch.column("n_words").to_numpy(zero_copy_only=False)
    offset = np.zeros(rows + 1, np.int64)
    np.cumsum(n_words + WINDOW * 4, out=offset[1:])  # a gap, so that no phrase spans two documents
    term = np.repeat(_ranks(np.concatenate([*terms, np.zeros(0, "<u8")]), known), np.concatenate([*counts, np.zeros(0, "<i4")]))
    place = np.concatenate([*places, np.zeros(0, "<i4")]).astype(np.int64) + np.repeat(offset[:-1], [len(p) for p in places])
    span = int(offset[-1]) + 1
    key = np.sort((term * span + place)[term >= 0])
    edges = np.searchsorted(key, np.arange(len(known) + 1) * span)
    return key, edges, offset, span


def _chunks(batch, most: int = 500_000):
    """Slices of an index batch with about ``most`` postings, or one document."""
    sizes = [len(p) // 4 for p in batch.column("positions").to_pylist()]
    at = n = 0
    for i, s in enumerate(sizes):
        if n and n + s > most:
            yield batch.slice(at, i - at)
            at, n = i, 0
        n += s
    if at < len(sizes):
        yield batch.slice(at)


def _intersect(plan, key, edges, span, within: int | None = None):
    """(window numbers, starts, lengths) of all exact occurrences, by window length; or, with
    ``within``, the places of rarest terms that have all others so near."""
    for base, terms, offsets in plan:
        rare = terms[:, 0].astype(np.int64)
        n = edges[rare + 1] - edges[rare]
        for low, high in _bounded(n):
            each = n[low:high]
            w = np.repeat(np.arange(low, high), each)
            run = np.arange(len(w)) - np.repeat(np.cumsum(each) - each, each)
            start = key[edges[rare[w]] + run] - rare[w] * span - (0 if within else offsets[w, 0])
            for r in range(1, terms.shape[1]):
                if not len(w):
                    break
                home = terms[w, r].astype(np.int64) * span
                want = home + (np.maximum(0, start - within) if within else start + offsets[w, r])
                at = np.searchsorted(key, want)
                at[at == len(key)] = 0
                near = key[at]
                alive = (near >= want) & (near <= home + start + within) if within else (near == want) & (start >= 0)
                w, start = w[alive], start[alive]
            yield w + base, start, np.full(len(w), terms.shape[1])


def _bounded(sizes: np.ndarray, most: int = 4_000_000):
    low, n = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if n and n + s > most:
            yield low, i
            low, n = i, 0
        n += s
    if low < len(sizes):
        yield low, len(sizes)


HITS = "uid long, n_words long, spans binary, items array<string>, near array<string>"


def _all(found) -> list[np.ndarray]:
    found = list(found)
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]


def _match(queries: Queries, plan, within: int | None):
    def items(w: np.ndarray, doc: np.ndarray, rows: int) -> list[list[str]]:
        at, out = np.searchsorted(doc, np.arange(rows + 1)), [[]] * rows
        for i in np.flatnonzero(np.diff(at)).tolist():
            out[i] = queries.items_of(w[at[i] : at[i + 1]])
        return out

    def run(batches):
        for batch in (part for whole in batches for part in _chunks(whole)):
            key, edges, offset, span = _postings(batch, queries.terms)
            w, start, size = _all(_intersect(plan, key, edges, span) if len(key) else [])
            doc = np.searchsorted(offset, start, side="right") - 1
            order = np.lexsort((start, doc))
            w, start, size, doc = w[order], start[order], size[order], doc[order]
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            spans = [b""] * batch.num_rows
            for i in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[i], at[i + 1])
                spans[i] = np.column_stack([start[part] - offset[i], start[part] - offset[i] + size[part]]).astype("<i8").tobytes()
            hit, near = items(w, doc, batch.num_rows), [[]] * batch.num_rows
            if within:
                w, start, _ = _all(_intersect(plan, key, edges, span, within) if len(key) else [])
                doc = np.searchsorted(offset, start, side="right") - 1
                order = np.argsort(doc, kind="stable")
                near = items(w[order], doc[order], batch.num_rows)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "uid", "n_words")), pa.array(spans, pa.binary()), pa.array(hit, kind), pa.array(near, kind)], ["doc_id", "uid", "n_words", "spans", "items", "near"])

    return run


def _whole(queries: Queries, plan, within: int | None):
    """Matches of the only block, summed up at once."""

    def run(batches):
        def lists():
            for b in _match(queries, plan, within)(batches):
                cols = [pa.array([[x] for x in b.column(c).to_pylist()], pa.list_(b.schema.field(c).type)) for c in ("spans", "items", "near")]
                yield pa.RecordBatch.from_arrays([*map(b.column, ("doc_id", "uid", "n_words")), *cols], b.schema.names)

        yield from _summary(lists())

    return run


def phrase_hits(index: DataFrame, queries: Queries, plan, within: int | None = None) -> DataFrame:
    """Per document: word spans of exact window occurrences (pairs of int64) and the items hit; and,
    with ``within``, the items near: all terms of a window stand so near its rarest."""
    return index.mapInArrow(lean(_match(queries, plan, within)), _schema(index, HITS))


def proximity_hits(index: DataFrame, queries: Queries, frequency: np.ndarray, within: int = WITHIN) -> DataFrame:
    """(doc_id, item_id as text) where all terms of a window stand within ``within`` words of its rarest."""
    return phrase_hits(index, queries, queries.plan(frequency), within).select("doc_id", F.explode("near").alias("item_id")).distinct()


def _summary(batches):
    for batch in batches:
        cols = [[], [], [], [], []]
        for n_words, spans, items, near in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items", "near"))):
            n_hit = 0
            pairs = [np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans if s]
            if pairs:
                hit = np.zeros(n_words + 1, np.int64)
                for p in pairs:
                    np.add.at(hit, p[:, 0], 1)
                    np.add.at(hit, p[:, 1], -1)
                n_hit = int((np.cumsum(hit)[:-1] > 0).sum())
            names = sorted({x for some in items for x in some})
            row = (n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, len({x for some in near for x in some}))
            for c, v in zip(cols, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "uid", "n_words")), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "uid", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])


SUMMARY = "uid long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"


def _judged(docs: DataFrame, benchmark: DataFrame, block_words: int, within: int | None) -> DataFrame:
    """The rows of ``decontaminate`` with uid, the hash of a row's id and text.

    With one block of benchmark items nothing is shuffled but term counts.  With more, each block
    reads the index again, and the hits of a document are brought together by its id.
    """
    index, hits, every = build_index(docs, term_bitmap(benchmark)), [], blocks(benchmark, block_words)
    first, second = next(every, []), next(every, None)
    queries = Queries(first)
    plan = queries.plan(term_frequencies(index, queries))
    if second is None:  # judged where it is found
        return index.mapInArrow(lean(_whole(queries, plan, within)), _schema(docs, SUMMARY))
    hits.append(phrase_hits(index, queries, plan, within))
    for items in itertools.chain([second], every):
        queries = Queries(items)
        hits.append(phrase_hits(index, queries, queries.plan(term_frequencies(index, queries)), within))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    whole = found.groupBy("doc_id", "uid").agg(F.max("n_words").alias("n_words"), *[F.collect_list(c).alias(c) for c in ("spans", "items", "near")], F.count("*").alias("rows"))
    # each block has a row for every document, so repeated documents come back as often as they are
    whole = whole.withColumn("copy", F.explode(F.expr(f"sequence(1, rows div {len(hits)})"))).select("doc_id", "uid", "n_words", "spans", "items", "near")
    return whole.mapInArrow(lean(_summary), _schema(docs, SUMMARY))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, block_words: int = BLOCK_WORDS, within: int | None = WITHIN) -> DataFrame:
    """One row per document: words, words hit, items hit, the verdict, and the number of items near
    (0 where ``within`` is None)."""
    return _judged(docs, benchmark, block_words, within).drop("uid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that do not hold benchmark passages in a twentieth of their words.

    Each row is judged by its own text: rows with a null id go if they leak, and a clean row stays
    though another row with its id leaks.
    """
    gone = _judged(docs, benchmark, BLOCK_WORDS, None).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid")).distinct()
    gone = stored(gone, "leaks", free=True)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == gone["__uid"]), "left_anti")
