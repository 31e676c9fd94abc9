"""The corpus pipeline: toxicity, near copies, benchmark leaks, source mix and shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; what it
returns is written as Parquet in the shared folder and read again for the next.  All stages but
the last return the columns of ``documents``; the last adds size, text_crc32, shard and slot.
A stage begins by deleting the scratch tables that no plan refers to any more; stages that are
composed lazily keep theirs.

Nulls and odd input, in every stage: a null or empty text is scored, has no shingles and no words,
is kept by the first three stages and never taken by the mix; rows with a null id are judged by
their own text and kept apart; repeated rows get equal verdicts, of rows with one id one stays
after the near-copy stage; ties are broken by ids and hashes; an empty table passes through; extra
columns are carried along whatever they are called (the last stage returns one that is named like
its own results as doc_<name>).

The random draws of the mix and the trained models keep SQL from expressing the whole, so there is
no ORACLE_SQL; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import decontaminate, mixing, neardup, sharding, toxicity
from sheaf.llm.common import stored, sweep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score 0.7 or more."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies, linked from a similarity of 0.8 on."""
    sweep(spark)
    return neardup.deduplicate(docs, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents with benchmark passages in a twentieth of their words."""
    sweep(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take blocks of the sources to their target weights."""
    sweep(spark)
    return mixing.mixed_documents(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mixed corpus to 16 shards of near equal bytes."""
    sweep(spark)
    return sharding.shard(docs, leaves=16, keep=tuple(c for c in docs.columns if c not in ("doc_id", "lang", "source")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", free=True)
    return docs
