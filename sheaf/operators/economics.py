"""Monthly storage cost of a corpus, zipped or as single objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: USD per GB-month, 1,000 reads, GB retrieved, 1,000 monitored objects; least billed KiB.
PRICES = {
    "standard": (0.023, 0.0004, 0.0, 0.0, 0), "standard_ia": (0.0125, 0.001, 0.01, 0.0, 128),
    "intelligent_tiering": (0.023, 0.0004, 0.0, 0.0025, 0), "glacier_instant": (0.004, 0.01, 0.03, 0.0, 128),
}
GIB_KIB = 1024.0 * 1024.0


def storage_costs(corpora: DataFrame, zip_ratio: float = 4.0) -> DataFrame:
    """Corpora (corpus, objects, avg_kib, access share) to cost by storage class."""
    gib = F.col("objects") * F.col("avg_kib") / GIB_KIB
    reads, read_gib = F.col("objects") * F.col("access"), gib * F.col("access")
    rows = [F.struct(F.lit("zip_standard").alias("storage_class"), (gib / zip_ratio * PRICES["standard"][0] + reads / 1000 * PRICES["standard"][1]).alias("usd_month"))]
    for name, (store, get, back, watch, least) in PRICES.items():
        billed = F.col("objects") * F.greatest(F.col("avg_kib"), F.lit(float(least))) / GIB_KIB
        watched = F.when(F.col("avg_kib") >= 128, F.col("objects")).otherwise(0) / 1000 * watch
        cost = billed * store + reads / 1000 * get + read_gib * back + watched
        rows.append(F.struct(F.lit(name).alias("storage_class"), cost.alias("usd_month")))
    return corpora.select("corpus", F.explode(F.array(*rows)).alias("c")).select("corpus", "c.storage_class", F.round("c.usd_month", 6).alias("usd_month"))
