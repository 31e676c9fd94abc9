"""Language identification: accuracy on held-out rows, and odd input."""

import os
import random

import pytest

from sheaf.llm import language
from sheaf.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd(spark, odd, empty):
    by = {r["doc_id"]: r for r in language.identify_languages(odd).collect()}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[9]["lang_pred"] == "und" and by[4]["score"] == 0
    assert {r["lang_pred"] for r in by.values()} <= {"en", "de", "fr", "und"}
    assert language.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    made = {"x": language.letters_only("red blue green " * 50), "y": language.letters_only("rot blau grun " * 50)}
    df = spark.createDataFrame([(1, "red blue green red blue green"), (2, "zzz qqq")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in language.identify(df, made).collect()}
    assert by[1]["lang_pred"] == "x" and not by[1]["rejected"] and by[2]["rejected"]


def test_predictions_against_plain_version(spark):
    """Each text encoded alone, by a coder made for it; dictionaries from whole texts of few rows."""
    import zstandard as zs

    rng = random.Random(3)
    stock = {"aa": "bal dor min sut kel", "bb": "xin qua zhe lou fen", "cc": "bal dor xin qua ert"}
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randrange(1, 200))) + rng.choice(["", "!", " 123", "É"]), lang) for i, lang in enumerate(rng.choice(sorted(stock)) for _ in range(300))]
    rows += [(1000, "bal " * 400_000, "aa"), (1001, None, "aa"), (1002, "12 34 !", "bb"), (1003, "xin", None), (1003, "xin", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language.learn_dictionaries(docs, sample_docs=20, dict_bytes=4_000)
    texts = {language.letters_only(t) for _, t, _ in rows if t}
    for lang, content in made.items():
        assert len(content) <= 4_000 + max(map(len, texts)) and 0 < sum(content.startswith(t) for t in texts)
    n = {lang: sum(x[2] == lang and x[1] is not None for x in rows) for lang in stock}
    assert list(made) == sorted(stock, key=lambda k: (-n[k], k))
    found = language.identify(docs, made).collect()
    assert len(found) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in found:
        t = text[r["doc_id"]]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        sizes = {}
        for lang, content in made.items():
            params = zs.ZstdCompressionParameters.from_level(language.LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=language.MIN_MATCH)
            coder = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = len(coder.compress(language.letters_only(t)))
        if r["margin"] > 0.1:  # a prepared dictionary may be searched a little differently
            assert r["lang_pred"] == min(sizes, key=sizes.get)
