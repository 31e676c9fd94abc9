"""Language identification by compression: one raw-content zstandard dictionary per language.

Texts are lower-cased and everything but letters becomes single spaces.  A text is encoded once
with each language's dictionary; the language whose dictionary makes it smallest wins.  Where the margin to the second is narrow, ``rejected`` is true (the prediction
stays, for callers that want one).

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language with more training rows; very long texts are encoded whole; repeated rows are judged alike;
null languages are not learned; without any learned language all rows are ``und``.  Extra columns
are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.common import id_fold
from sheaf.llm.wordpos import lean, row_groups

SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
LEVEL, MIN_MATCH = 9, 3
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """What is encoded: lower-case words, one space before and after each."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "ignore")


def coders(dictionaries: dict[str, bytes]) -> list:
    """Encoding functions of the languages, in the order of the dictionaries."""
    import zstandard as zs

    out = []
    for lang in dictionaries:
        params = zs.ZstdCompressionParameters.from_level(LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=MIN_MATCH)
        content = zs.ZstdCompressionDict(dictionaries[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        out.append(zs.ZstdCompressor(dict_data=content, compression_params=params).compress)
    return out


def learn_dictionaries(train: DataFrame, *, sample_docs: int = 120, dict_bytes: int = 98_304, seed: int = 29) -> dict[str, bytes]:
    """Raw dictionary content by language: whole texts of at most ``sample_docs`` documents.

    A language's documents are taken in the order of a hash until they have ``dict_bytes``; the
    last one is not cut.  ``train`` has doc_id, text and lang.
    """
    train = train.where("lang is not null and text is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    wide = sample_docs + 4 * sample_docs**0.5  # so that hardly ever fewer are under the share
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 63) * min(1.0, wide / n)) - 1)])
    some = train.where(F.col("h") <= share[F.col("lang")]).select("lang", "h", F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.withColumns({"nth": F.row_number().over(order), "before": before}).where((F.col("nth") <= sample_docs) & (F.col("before") < dict_bytes))
    picked = sorted({r["h"] for r in chosen.select("h").collect()})
    rows = train.where(F.col("h").isin(picked)).select("lang", "h", "text").collect() if picked else []
    out = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        out[lang] = b"".join(letters_only(r["text"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["h"], r["text"])))
    return {k: v for k, v in out.items() if v.strip()}


def _predict(dictionaries: dict[str, bytes], narrow: float, least: int):
    def run(batches):
        langs, encode = list(dictionaries), coders(dictionaries)
        for batch in (part for whole in batches for part in row_groups(whole)):
            rows = []
            for text in batch.column("text").to_pylist():
                if not langs or not text or not any(map(str.isalpha, text)):
                    rows.append(("und", 0.0, 0.0, True))
                    continue
                raw = letters_only(text)
                sizes = [len(c(raw)) for c in encode]
                best = min(range(len(langs)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
                gap = second - sizes[best]
                score = 1 / sum(math.exp(-min(50.0, (s - sizes[best]) / 2)) for s in sizes)
                rows.append((langs[best], score, gap / second, gap < max(least, narrow * second)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, narrow: float = 0.01, least: int = 2) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, margin and rejected."""
    return docs.select("doc_id", "text").mapInArrow(lean(_predict(dictionaries, narrow, least)), SCHEMA)


def identify_languages(docs: DataFrame, *, folds: int = 5) -> DataFrame:
    """Learn from the rows whose fold is not 0 and predict all; held_out marks fold 0."""
    dictionaries = learn_dictionaries(docs.select("doc_id", "text", "lang").where(id_fold(folds) != 0))
    found = identify(docs, dictionaries)
    return found.select("doc_id", (id_fold(folds) == 0).alias("held_out"), "lang_pred", F.round("score", 9).alias("score"), "margin", "rejected")
