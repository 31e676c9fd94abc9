"""Golden values of the scalar functions."""

# The inputs and results that are spelled out below state agreed behaviour (refused and
# accepted paths, planned blocks, statuses, delays); they stay as they are.

from pyspark.sql import functions as F

from sheaf.functions import etags, paths, text, tuning


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_etags(spark):
    rows = [('"D41D8CD98F00B204E9800998ECF8427E"',), ('"abc-2"',), ("not-md5",), (None,), ('\t"d41d8cd98f00b204e9800998ecf8427e" ',)]
    found = values(spark, rows, "e string", m=etags.normalize_etag(F.col("e")))
    assert found == [(etags.EMPTY_MD5,), (None,), (None,), (None,), (etags.EMPTY_MD5,)]


def test_comparable(spark):
    md5 = etags.EMPTY_MD5
    rows = [(10, 11, md5), (10, 10, md5), (10, 10, md5 + "-2"), (10, None, md5)]
    found = values(spark, rows, "a long, b long, e string", m=etags.comparable_md5(F.col("a"), F.col("b"), F.col("e")))
    assert found == [(None,), (md5,), (None,), (md5,)]


def test_paths(spark):
    bad = ["/abs.txt", "../escape.txt", "a/../escape.txt", "a//b.txt", "C:/x.txt", "a\\b.txt", "", "/", "//", ".", "a/.", "a\0b", "C:", "a/./b/"]
    found = values(spark, [(b,) for b in bad], "p string", e=paths.path_error(F.col("p")), n=paths.normalized_path(F.col("p")))
    assert all(e is not None and n is None for e, n in found)
    good = [("a/b.txt", "a/b.txt"), ("dir/", "dir/"), ("dir//", "dir/"), ("a/C:/x", "a/C:/x"), ("...", "..."), ("a/..b", "a/..b")]
    found = values(spark, [(g,) for g, _ in good], "p string", n=paths.normalized_path(F.col("p")), e=paths.path_error(F.col("p")))
    assert [n for n, _ in found] == [n for _, n in good] and not any(e for _, e in found)


def test_keys(spark):
    rows = [("", "a.txt"), ("prefix", "a.txt"), ("prefix/", "a.txt")]
    assert [r[0] for r in values(spark, rows, "a string, b string", k=paths.join_key(F.col("a"), F.col("b")))] == ["a.txt", "prefix/a.txt", "prefix/a.txt"]
    rows = [("site", "site/a/b", 3), ("site", "other/a", 1), ("", "x", 1), ("site", "site/", 0), ("site", "site/", 4), ("site", "site/d/", 2), ("site", "site/d/", 0)]
    found = values(spark, rows, "p string, k string, n long", e=paths.key_entry_error(F.col("p"), F.col("k"), F.col("n")), z=paths.key_to_path(F.col("p"), F.col("k")))
    assert [e is None for e, _ in found] == [True, False, True, True, False, False, True]
    assert [z for _, z in found] == ["a/b", None, "x", "", "", "d/", "d/"]


def test_uris(spark):
    rows = [("s3://b/k/x",), ("s3://b",), ("s3:///k",), ("http://b/k",), ("s3://b//k",)]
    p = paths.object_uri(F.col("u"))
    found = values(spark, rows, "u string", b=p["bucket"], k=p["key"], x=p["prefix"], e=p["error"])
    assert found[0] == ("b", "k/x", "k/x", None) and found[1][3] == "missing object key" and found[2][3] == "missing bucket"
    assert found[3][3] == "missing s3:// scheme" and found[4][1:3] == ("/k", "k")


def test_local_names(spark):
    rows = {"ok/file.txt": False, "con": True, "a/NUL.txt": True, "com1": True, "com10": False, "a:b": True, "end.": True, "end ": True, "a/b\x07": True, "conin$": True, "console": False, "a/aux /b": True}
    found = values(spark, [(k,) for k in rows], "p string", u=paths.unsafe_local_path(F.col("p")))
    assert [u for (u,) in found] == list(rows.values())
    assert values(spark, [("a/b/c",), ("x",)], "p string", a=paths.ancestors(F.col("p"))) == [(["a", "a/b"],), ([],)]
    assert values(spark, [("aBc-1",)], "p string", a=paths.swap_case(F.col("p"))) == [("AbC-1",)]
    found = values(spark, [("dir/../file.bin",), ("/tmp/file.bin",), ("C:temp/file.bin",), ("dir\\file.bin",), ("dir/file.bin",)], "p string", s=paths.safe_manifest_path(F.col("p")))
    assert [s for (s,) in found] == [False] * 4 + [True]


def test_backoff(spark):
    rows = [(1, False), (2, False), (3, False), (6, False), (60, False), (1, True), (60, True)]
    found = values(spark, rows, "n int, t boolean", d=tuning.backoff_ms(F.col("n"), F.col("t")))
    assert [d for (d,) in found] == [250, 500, 1000, 5000, 5000, 1000, 30000]
    jitter = values(spark, rows, "n int, t boolean", d=tuning.retry_delay_ms(F.col("n"), F.col("t")))
    assert all(0 <= j <= d for (j,), (d,) in zip(jitter, found))
    found = values(spark, [("SlowDown",), ("ThrottlingException",), ("PreconditionFailed",), ("service_error",), (None,)], "c string", t=tuning.is_throttle(F.col("c")))
    assert [t for (t,) in found] == [True, True, False, False, False]
    assert values(spark, [(412, None), (None, "PreconditionFailed"), (500, "x")], "s int, c string", t=tuning.is_conflict(F.col("s"), F.col("c"))) == [(True,), (True,), (False,)]


def test_sizing(spark):
    rows = [(m,) for m in (0, 128, 256, 512, 1024, 2048, 3008)]
    found = values(spark, rows, "m long", w=tuning.worker_count(F.col("m")), g=tuning.get_concurrency(F.col("m")))
    assert [w for w, _ in found] == [4, 4, 6, 8, 11, 16, 16]
    gib3, mib = 3 * 1024**3, 1024**2
    rows = [(256, gib3, 49152, 6, 1), (256, gib3, 65536, 6, 1), (256, 423545, 10, 6, 1)]
    found = values(spark, rows, "m long, z long, f long, w long, g long", c=tuning.adaptive_window(*map(F.col, "mzfwg")))
    assert [c for (c,) in found] == [16 * mib, 8 * mib, 423545]


def test_text(spark):
    found = values(spark, [("10KB",), ("1.5KiB",), ("7",), ("2 GiB",), ("x",), ("5XB",)], "s string", n=text.parse_size(F.col("s")))
    assert [n for (n,) in found] == [10000, 1536, 7, 2 * 1024**3, None, None]
    line = "REPORT RequestId: abc\tDuration: 12.50 ms\tBilled Duration: 13 ms\tMemory Size: 256 MB\tMax Memory Used: 99 MB"
    p = text.report_line(F.col("l"))
    assert values(spark, [(line,), ("END",)], "l string", **p) == [("abc", 12.5, 13, 256, 99), (None,) * 5]
    assert values(spark, [(1536, 75)], "n long, s long", a=text.human_bytes(F.col("n")), b=text.human_elapsed(F.col("s"))) == [("1.5 KiB", "01:15")]
