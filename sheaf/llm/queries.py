"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, gif, language, mixing, neardup, oracles, quality, repeats, sharding, toxicity, url_filter
from sheaf.llm.common import table


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.QUERY_RULES)


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_media(gif.store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return sharding.shard(docs, leaves=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed, _ = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict:
    return {f.__name__: f for f in (op1_repeat_removal, op2_decontamination, op3_language_id, op4_quality, op5_near_duplicates, op6_url_filter, op7_gif_media, op8_sharding, op9_mixing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_repeat_removal": oracles.REPEATS, "op2_decontamination": oracles.LEAKS, "op5_near_duplicates": oracles.NEAR}
