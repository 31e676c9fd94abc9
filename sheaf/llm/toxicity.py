"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and stems of four to six letters, that documents labelled toxic
have far more often than the others.  Obfuscated words (digits and signs for letters, letters
drawn apart) are restored before they are looked up and counted apart.

Nulls and odd input: a null or empty text has all features 0 and still gets a score; very long
texts are processed whole; repeated rows get equal scores; labels of unknown documents, and null
labels, are ignored; without labels of both kinds every score is the share of toxic labels (0 if
there are none).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.calibrate import apply_bins, fit_bins
from sheaf.llm.common import at_most, id_fold, stored
from sheaf.llm.wordpos import SPAN, lean, prefix_sums, range_hash, row_groups

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Signs that stand for letters, and second-person pronouns of four languages.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SECOND = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ti tus vosotros".split())
FEATURES = (
    "top", "total", "hits", "density", "distinct", "near_you", "you", "capitals", "shout", "punct", "bangs", "obfuscated", "mixed", "log_words",
)
#: Their names beside the columns of a document, which may be called anything.
COLUMNS = tuple(f"__tox_{f}" for f in FEATURES)


def keys(words) -> set[str]:
    """Distinct words and their stems (marked by a star)."""
    out = set(words)
    out.update(w[:n] + "*" for w in set(words) for n in STEMS if len(w) > n)
    return out


def _count_batches(batches):
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in (part for whole in batches for part in row_groups(whole)):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            counts[y].update(keys(WORD.findall((text or "").lower())))
    every = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(every), 50_000):
        part = every[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[y][k] for k in part], pa.int64()) for y in (1, 0)]], ["key", "tox", "clean"])


def learn_lexicon(train: DataFrame, *, least: int = 4, weight: float = 4.0, entries: int = 3_000) -> dict[str, float]:
    """Weights (log odds) of the strongest keys; at most ``entries``.  ``train`` has text and y."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return {}
    counts = train.select("text", "y").mapInArrow(lean(_count_batches), "key string, tox long, clean long").groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("tox") + 0.5) / (pos - F.col("tox") + 0.5)) - F.log((F.col("clean") + 0.5) / (neg - F.col("clean") + 0.5))
    best = counts.where(F.col("tox") >= max(least, math.ceil(pos * 0.004))).withColumn("w", odds).where(F.col("w") >= weight)
    return {r["key"]: r["w"] for r in best.orderBy(F.desc("w"), "key").limit(entries).collect()}


LETTER, SIGN, SPACE, GAP, CAPITAL, PUNCT, BANG, UPPER = (np.uint8(1 << i) for i in range(8))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: classes (bits), lower case, and lower case with signs read as letters."""
    kinds, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() and not c.isdecimal():
            kinds[i] |= LETTER | (UPPER if c.isupper() else 0)
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
        elif c.isspace():
            kinds[i] |= SPACE
    for chars, bit in (("0123456789@$!", SIGN), (".-*_ ", GAP), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), (".,;:?!\"'()-*#%&$|", PUNCT), ("!", BANG)):
        kinds[[ord(c) for c in chars]] |= bit
    plain = low.copy()
    for sign, letter in LEET.items():
        plain[ord(sign)] = ord(letter)
    return kinds, low, plain


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of words, as ``range_hash`` gives them over code points."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    return range_hash(prefix_sums(codes), end - [len(w) for w in words], end)


class Lexicon:
    """Weights of words and stems by hash."""

    def __init__(self, weights: dict[str, float]):
        words, stems = [w for w in weights if w[-1] != "*"], [w for w in weights if w[-1] == "*"]
        self.words, self.stems = self._table(words, [weights[w] for w in words]), self._table([w[:-1] for w in stems], [weights[w] for w in stems])
        self.second = np.sort(_hashes(sorted(SECOND)))

    @staticmethod
    def _table(words, weights):
        h = _hashes(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        return h[order], np.array(weights, np.float64)[order]

    @staticmethod
    def _find(h: np.ndarray, table) -> np.ndarray:
        keys, weights = table
        if not len(keys):
            return np.zeros(len(h))
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, weights[at], 0.0)

    def weigh(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """Weight of each word: the largest of its own and its stems' weights."""
        w = self._find(range_hash(sums, start, end) if h is None else h, self.words)
        for n in STEMS if len(self.stems[0]) else ():
            longer = np.flatnonzero(end - start > n)
            w[longer] = np.maximum(w[longer], self._find(range_hash(sums, start[longer], start[longer] + n), self.stems))
        return w

    def is_second(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.second, h)
        at[at == len(self.second)] = 0
        return self.second[at] == h


def pieces(text: str, most: int = SPAN) -> list[str]:
    """A text in pieces of at most ``most`` characters, cut after a space if there is one."""
    out, at = [], 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most)) + 1
        cut = cut if cut > at else at + most
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _measure(units: list[tuple[int, str]], lexicon: Lexicon, out: dict[str, np.ndarray], seen: list[np.ndarray]) -> None:
    """Add the counts of some pieces (document, text) to those of their documents."""
    kinds, low, plain = _tables()
    parts = [np.frombuffer(f"{t}\n".encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in units]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=begin[1:])
    docs, codes = np.array([d for d, _ in units]), np.concatenate(parts)
    kind = kinds[codes]
    unit_of = lambda at: np.searchsorted(begin, at, "right") - 1
    add = lambda name, at, by=1.0: np.add.at(out[name], docs[unit_of(at)], by)
    np.add.at(out["chars"], docs, np.diff(begin) - 1)
    for name, bit in (("capitals", CAPITAL), ("punct", PUNCT), ("bangs", BANG)):
        np.add.at(out[name], docs, np.add.reduceat((kind & bit) != 0, begin[:-1], dtype=np.int64))
    start, end = _runs((kind & LETTER) != 0)
    if not len(start):
        return
    sums = prefix_sums(low[codes])
    h, size = range_hash(sums, start, end), end - start
    add("words", start)
    upper = np.concatenate([[0], np.cumsum((kind & UPPER) != 0)])
    add("shout", start[(size > 2) & (upper[end] - upper[start] == size)])
    w, you = lexicon.weigh(sums, start, end, h), lexicon.is_second(h)
    add("you", start[you])
    hit = np.flatnonzero(w > 0)
    if len(hit):
        doc = docs[unit_of(start[hit])]
        np.maximum.at(out["top"], doc, w[hit])
        np.add.at(out["total"], doc, w[hit])
        np.add.at(out["hits"], doc, 1.0)
        seen.append(np.unique(np.column_stack([doc.astype(np.uint64), h[hit]]), axis=0))
        place = np.arange(len(start)) + unit_of(start) * 16  # pieces are far apart
        at = place[you]
        close = np.searchsorted(at, place[hit] + 5, "right") > np.searchsorted(at, place[hit] - 5, "left")
        np.add.at(out["near_you"], doc[close], 1.0)
    # obfuscated: tokens with a sign before a letter, and letters drawn apart
    marks = np.flatnonzero(((kind[:-1] & SIGN) != 0) & ((kind[1:] & LETTER) != 0))
    if len(marks):
        first, last = _runs((kind & SPACE) == 0)
        token = np.unique(np.searchsorted(first, marks, "right") - 1)
        first, last = first[token], last[token]
        add("mixed", first)
        length = last - first + 1  # with the space that follows
        inside = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        owner = np.repeat(np.arange(len(first)), length)
        read = plain[codes[inside]]
        letter = (kinds[read] & LETTER) != 0
        whole, whole_of = read[letter], owner[letter]  # all letters of a token, joined
        a, b = np.searchsorted(whole_of, np.arange(len(first))), np.searchsorted(whole_of, np.arange(len(first)), "right")
        found = lexicon.weigh(prefix_sums(whole), a, b) >= 4.0
        a, b = _runs(letter)  # its words
        strong = lexicon.weigh(prefix_sums(read), a, b) >= 4.0
        found[owner[a[strong]]] = True
        add("obfuscated", first[found])
    single = size == 1
    link = single[:-1] & single[1:] & (start[1:] == end[:-1] + 1) & ((kind[np.minimum(end[:-1], len(kind) - 1)] & GAP) != 0)
    a, b = _runs(link)
    a, b = a[b - a >= 3], b[b - a >= 3] + 1
    if len(a):
        add("mixed", start[a])
        strong = lexicon.weigh(prefix_sums(low[codes[start]]), a, b) >= 4.0
        add("obfuscated", start[a[strong]])


COUNTS = ("chars", "words", "capitals", "punct", "bangs", "shout", "you", "near_you", "top", "total", "hits", "mixed", "obfuscated")


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Dense features, a row for each text.  Long texts are measured in pieces, which add up; only
    a hit and a pronoun on two sides of a cut are not seen as near."""
    out, seen, units, size = {c: np.zeros(len(texts)) for c in COUNTS}, [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            if units and size + len(piece) > SPAN:
                _measure(units, lexicon, out, seen)
                units, size = [], 0
            units.append((i, piece))
            size += len(piece) + 1
    if units:
        _measure(units, lexicon, out, seen)
    distinct = np.zeros(len(texts))
    if seen:
        pairs = np.unique(np.concatenate(seen), axis=0)
        np.add.at(distinct, pairs[:, 0].astype(np.int64), 1.0)
    n, chars = np.maximum(out["words"], 1), np.maximum(out["chars"], 1)
    return np.column_stack([
        out["top"], out["total"], out["hits"], out["hits"] / n, distinct, out["near_you"] / n, out["you"] / n, out["shout"] / n,
        out["capitals"] / chars, out["punct"] / chars, out["bangs"] / chars, out["obfuscated"], out["mixed"] / n, np.log1p(out["words"]),
    ])


def _featurise(weights: dict[str, float]):
    def run(batches):
        lexicon = Lexicon(weights)
        for batch in (part for whole in batches for part in row_groups(whole)):
            cols = features(batch.column("text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cols[:, i]) for i in range(len(FEATURES))]], [*batch.schema.names, *COLUMNS])

    return run


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """All columns of ``docs`` and the dense features of its text."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in COLUMNS]])
    return docs.mapInArrow(lean(_featurise(lexicon)), schema)


def labelled_text(docs: DataFrame, labels: DataFrame, label: str, use, rows: int, seed: int = 3) -> DataFrame:
    """(doc_id, text, y) of the documents of at most ``rows`` labels where ``use`` holds.

    Of labels that contradict each other the larger one holds."""
    known = labels.where(F.col(label).isin(0, 1) & use).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = at_most(known, rows, known.count(), "doc_id", seed=seed)
    # not more than ``rows`` pairs of numbers, so they are sent to the documents rather than they to them
    return stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "labelled")


class Model:
    """Lexicon, trees and calibration; ``fit`` learns them."""

    def __init__(self, lexicon, trees, levels, share):
        self.lexicon, self.trees, self.levels, self.share = lexicon, trees, levels, share

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 5) -> Model:
        """Fitted on at most ``train_rows`` labels of documents whose fold is not 1: the lexicon and
        trees on three quarters of them, the calibration on the rest."""
        train = labelled_text(docs, labels, "toxic", id_fold(3) != 1, train_rows)
        part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))
        n = train.agg(F.count("*").alias("n"), F.sum(F.when(part != 0, F.col("y"))).alias("p"), F.sum(F.when(part != 0, 1)).alias("m")).first()
        pos, total = n["p"] or 0, n["m"] or 0
        lexicon = learn_lexicon(train.where(part != 0))
        if not 0 < pos < total:
            return cls(lexicon, None, None, pos / total if total else 0.0)
        seen = stored(with_features(train, lexicon), "toxic-train")
        vectors = VectorAssembler(inputCols=list(COLUMNS), outputCol="features")
        fitted = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(vectors.transform(seen.where(part != 0)).select("y", "features"))
        model = cls(lexicon, fitted, None, 0.0)
        model.levels = fit_bins(model._raw(seen.where(part == 0)), "__tox_raw", "y")
        return model

    def _raw(self, dense: DataFrame) -> DataFrame:
        vectors = VectorAssembler(inputCols=list(COLUMNS), outputCol="__tox_features")
        trees = self.trees.setFeaturesCol("__tox_features").setRawPredictionCol("__tox_margin").setProbabilityCol("__tox_chance").setPredictionCol("__tox_class")
        return trees.transform(vectors.transform(dense)).withColumn("__tox_raw", vector_to_array("__tox_chance")[1])

    def transform(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs``, the dense features and ``__tox_score``."""
        dense = with_features(docs, self.lexicon)
        if self.trees is None:
            return dense.withColumn("__tox_score", F.lit(self.share))
        return self._raw(dense).withColumn("__tox_score", F.round(apply_bins(F.col("__tox_raw"), self.levels), 9))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fit) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and the dense features."""
    scored = Model.fit(docs, labels, **fit).transform(docs.select("doc_id", "text"))
    dense = [F.col(c).alias(f) for c, f in zip(COLUMNS, FEATURES)]
    return scored.select("doc_id", (id_fold(3) == 1).alias("held_out"), F.col("__tox_score").alias("score"), (F.col("__tox_score") >= threshold).cast("int").alias("predicted"), *dense)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, unchanged; nothing is shuffled."""
    return Model.fit(docs, labels, **fit).transform(docs).where(F.col("__tox_score") < threshold).select(*docs.columns)
