"""Isotonic calibration from binned scores (pool adjacent violators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 200


def pool_adjacent(bins: list[tuple[float, float]]) -> list[float]:
    """Non-decreasing fit of (weight, sum of labels) in order; empty bins take the level below."""
    blocks: list[list[float]] = []  # weight, sum, bins covered
    for weight, total in bins:
        blocks.append([weight, total, 1])
        while len(blocks) > 1 and (not blocks[-1][0] or not blocks[-2][0] or blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]):
            w, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, blocks[-1][2] + n]
    return [t / w if w else 0.5 for w, t, n in blocks for _ in range(int(n))]


def fit_bins(scored: DataFrame, raw: str, label: str) -> list[float]:
    """Calibrated level of each of BINS equal score bins in [0, 1]; only the bins reach the driver."""
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col(raw) * BINS))).cast("int")
    rows = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).collect()
    hist = [(0.0, 0.0)] * BINS
    for r in rows:
        hist[r["bin"]] = (float(r["n"]), float(r["pos"] or 0))
    return pool_adjacent(hist)


def apply_bins(raw: Column, levels: list[float], slope: float = 0.02) -> Column:
    """The level of a raw score's bin, with a small share of the raw score to keep its order."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0))))
    at = F.least(F.lit(BINS - 1), F.floor(clipped * BINS)).cast("int")
    level = F.element_at(F.array(*[F.lit(float(x)) for x in levels]), at + 1)
    return level * (1 - slope) + clipped * slope
