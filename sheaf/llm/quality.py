"""Quality scores: random Fourier features, ridge normal equations and isotonic calibration.

Statistics of each text are standardised and mapped by cosines of random projections, which
approximate a Gaussian kernel.  Every partition sums its part of the normal equations; the sums
are added up in Spark and the small system (features x features) is solved on the driver.

Nulls and odd input: a null or empty text has all statistics 0 and still gets a score; very long
texts are processed whole; repeated rows get equal scores; null labels and labels of unknown
documents are ignored; of labels that contradict each other the larger one holds; without labels
of both kinds every score is the share of label 1 (0.5 if there are no labels).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.calibrate import apply_bins, fit_bins
from sheaf.llm.common import id_fold, stored
from sheaf.llm.wordpos import lean, row_groups

STATS = (
    "log_bytes", "log_words", "word_len", "word_dev", "distinct", "top_word", "runs", "upper", "digit", "space", "comma_stop", "bang", "pipe", "marks",
    "other_punct", "high", "line_len", "log_lines", "line_repeats", "ends_marked", "squeeze", "at_url",
)
SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
#: Classes of bytes for the ratios above.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r", "comma_stop": b",.;:", "bang": b"!?", "pipe": b"|", "marks": b"#$%&*@^~<>{}[]\\", "other_punct": b"'\"()-_/+="}
MEMBER = np.zeros((256, len(CLASSES) + 1))
for _i, _chars in enumerate(CLASSES.values()):
    MEMBER[list(_chars), _i] = 1.0
MEMBER[128:, -1] = 1.0


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8")
    words = (text or "").split()
    n, size = len(words), len(raw)
    if not size:
        return [0.0] * len(STATS)
    classes = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ MEMBER) / size
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = text.split("\n")
    runs = sum(a == b for a, b in zip(words, words[1:]))
    marked = sum(w[-1] in "!#$%&*|" for w in words)
    upper, digit, space, stops, bang, pipe, marks, other, high = classes
    return [
        math.log1p(size), math.log1p(n), float(lens.mean()), float(min(lens.std(), 50.0)), len(counts) / max(1.0, math.sqrt(n) * 4), max(counts.values(), default=0) / max(1, n), runs / max(1, n),
        upper, digit, space, stops, bang, pipe, marks, other, high, math.log1p(size / len(lines)), math.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        marked / max(1, n), len(zlib.compress(raw, 1)) / size if size > 64 else 1.0, (text.count("@") + text.count("://")) / max(1, n),
    ]


def _stat_batches(batches):
    for batch in (part for whole in batches for part in row_groups(whole)):
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        cols = np.array(rows, dtype=np.float64).reshape(len(rows), len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(cols[:, i]) for i in range(len(STATS))]], ["doc_id", *STATS])


class Kernel:
    """Standardisation and the random cosine map: x to (1, standardised x, cosines)."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        width = math.sqrt(2.0 * len(mean))
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), size)), rng.uniform(0, 2 * math.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS])


def _equations(kernel: Kernel):
    def run(batches):
        total = None
        for batch in batches:
            z, y = kernel(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            part = np.vstack([z.T @ z, (z.T @ y)[None, :]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "v"])

    return run


def _scores(kernel: Kernel, beta: np.ndarray):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kernel(_matrix(batch)) @ beta)], ["doc_id", "raw"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, *, size: int = 128, ridge: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 at 0.5 or more).

    All labelled documents whose fold is not 1 are used: four fifths for the ridge fit, the rest
    for calibration.
    """
    stats = stored(docs.select("doc_id", "text").mapInArrow(lean(_stat_batches), SCHEMA), "quality-stats")
    known = labels.where(F.col("quality").isin(0, 1) & (id_fold(3) != 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    train = stored(stats.join(known, "doc_id"), "quality-train")
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))
    fit_on = train.where(part != 0)
    sums = fit_on.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *[F.avg(s).alias(f"m_{s}") for s in STATS], *[F.stddev_pop(s).alias(f"d_{s}") for s in STATS]).first()
    if not sums["n"] or not 0 < sums["pos"] < sums["n"]:
        score = F.lit(sums["pos"] / sums["n"] if sums["n"] else 0.5)
        return _result(stats.withColumn("score", score))
    kernel = Kernel(np.array([sums[f"m_{s}"] for s in STATS]), np.array([sums[f"d_{s}"] for s in STATS]), size, seed)
    k = 1 + len(STATS) + size
    flat = np.zeros((k + 1) * k)
    for r in fit_on.mapInArrow(lean(_equations(kernel)), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
        flat[r["at"]] = r["v"]
    gram, rhs = flat[: k * k].reshape(k, k), flat[k * k :]
    beta = np.linalg.solve(gram + ridge * np.diag([1e-6] + [1.0] * (k - 1)), rhs)
    raw = lambda df: df.mapInArrow(lean(_scores(kernel, beta)), "doc_id long, raw double")
    levels = fit_bins(raw(train.where(part == 0)).join(known, "doc_id"), "raw", "y")
    return _result(raw(stats).withColumn("score", apply_bins(F.col("raw"), levels)))


def _result(scored: DataFrame) -> DataFrame:
    score = F.round("score", 9)
    return scored.select("doc_id", (id_fold(3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
