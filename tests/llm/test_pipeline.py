"""The pipeline, stage by stage and as a whole."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline as cp
from sheaf.llm import common, decontaminate, neardup, queries
from sheaf.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_registered():
    found = driver.queries()
    assert [n for n in found if n.startswith("op")] == list(queries.queries()) and found["pipeline"] is cp.run
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert 4 <= len(cp.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["near_duplicates"]
    assert ids(after) == {r["doc_id"] for r in neardup.near_duplicates(before, percent=80).where("kept").collect()}
    before, after = seen["decontamination"]
    leaks = decontaminate.decontaminate(before, table(spark, SF, "benchmark"))
    assert ids(before) - ids(after) == {r["doc_id"] for r in leaks.where("contaminated").collect()}
    mixed, shards = seen["sharding"]
    assert shards.count() == mixed.count() and sorted((r["doc_id"], r["text"]) for r in shards.collect()) == sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert cp.run(spark, SF).count() == shards.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_lazy_stages_keep_their_tables(spark):
    """Stages composed without writing between them; tables that nothing reads any more go."""
    docs = table(spark, SF, "documents").limit(120)
    for (name, first), (_, second) in (cp.STAGES[1:3], cp.STAGES[3:5]):
        assert stored(second(spark, first(spark, docs, SF), SF), "test-two").count() > 0, name
    held = stored(spark.range(5), "held")
    path, gone = common._tables[-1][0], stored(spark.range(5), "gone")
    lost = common._tables[-1][0]
    kept = held.where("id > 1")
    del held, gone
    for _ in range(20):  # the JVM learns with some delay that Python holds a table no more
        common.sweep(spark)
    exists = lambda p: common._fs(spark, p, "exists")
    assert kept.count() == 3 and exists(path) and not exists(lost)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows and columns that are named like the stages' own."""
    names = ["_gone", "_uid", "_u", "uid", "copy", "parts", "h", "top", "score", "shard", "y", "__k", "n"]
    docs = stored(odd.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]), "odd")
    blank = stored(empty.select("*", *[F.lit("x").alias(n) for n in ("size", *names)]), "blank")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    before = ids(docs)
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), "odd-out")
        last = name == "sharding"
        if not last:
            assert out.columns == docs.columns, name
        for r in out.collect():
            for n in names:
                assert r[f"doc_{n}" if last and n in ("shard",) else n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}", (name, n)
        left = ids(out)
        if name in ("toxicity", "decontamination", "sharding"):
            assert left == before, name
        elif name == "near_duplicates":
            assert set(left.values()) == {1} and set(before) - set(left) == {2, 3}
        else:
            assert not {4, 5, 9} & set(left) and all(r["text"] and r["n_chars"] == len(r["text"]) for r in out.collect())
        assert stored(stage(spark, blank, SF), "blank-out").count() == 0
