"""URL rules and trees."""

import pytest
from pyspark.sql import functions as F

from sheaf.llm import url_filter as u

URLS = {
    "https://a.ORG/x": ("a.org", "/x", "org/", "allow"), "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "http://www.example.org/en/15?q": ("www.example.org", "/en/15", "example.org/en/1", "block"),
    "http://m.x.com/fr/?a": ("m.x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/1#f": ("x.com", "/de/1", "com/de/", "block"), "http://notorg/x": ("notorg", "/x", None, None), "no scheme": ("", "", None, None),
    "http://x.org": ("x.org", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "http://org/": ("org", "/", "org/", "allow"), "http://y.com/frx": ("y.com", "/frx", None, None), "http://É.com/DE/": ("É.com", "/DE/", None, None),
}


def test_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)] + [(0, "https://a.ORG/x")], "page_id long, url string")
    rows = u.judge_urls(df, u.QUERY_RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert u.judge_urls(df.limit(0), u.QUERY_RULES).count() == 0
    assert {r["verdict"] for r in u.judge_urls(df, ()).collect()} == {"allow"}


def test_trees_learn_labels(spark):
    rows = [(i, f"http://site{i}.example.net/page/{i}") for i in range(200)] + [(1000 + i, f"http://win-{i}-casino-{i * 77}.example.biz/a/b/c/d?x={i}&y=2&z=3") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = df.where("page_id % 2 = 0").select("url", (F.col("page_id") >= 1000).cast("int").alias("label"))
    out = u.judge_urls(df, (), labelled=labelled)
    good = out.where((F.col("verdict") == "block") == (F.col("page_id") >= 1000)).count()
    assert good / 400 > 0.97


@pytest.mark.parametrize("url", ["x" * 5000, "http://" + "a." * 500 + "org/" + "/" * 300])
def test_long(spark, url):
    assert u.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), u.QUERY_RULES).count() == 1
