"""Selection, spans, intervals, checks, diagnostics and fixtures."""

# The inputs and results that are spelled out below state agreed behaviour (refused and
# accepted paths, planned blocks, statuses, delays); they stay as they are.

import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheaf.operators import checks, diagnostics, economics, fixtures, intervals, ranges, spans
from sheaf.operators.selection import Selection, selected
from sheaf.sources import roundtrip


def chosen(spark, names, selection):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    return {r["p"] for r in df.where(selected(F.col("p"), selection)).collect()}


def test_selection(spark):
    names = ["index.md", "docs/live.md", "docs/drafts/old.md", "images/logo.png"]
    assert Selection().include("!important.md").lines == ("\\!important.md",) and Selection().exclude("#draft.md").lines == ("!\\#draft.md",)
    assert chosen(spark, names, Selection().exclude("docs/drafts/**")) == {"index.md", "docs/live.md", "images/logo.png"}
    assert chosen(spark, names, Selection().include("docs/**").exclude("docs/drafts/**")) == {"docs/live.md"}
    assert chosen(spark, names, Selection()) == set(names)
    assert chosen(spark, names, Selection().patterns("", "# note")) == set(names)
    odd = [" #notes.md", " !important.md", "other.md"]
    assert chosen(spark, odd, Selection().include(" #notes.md").include(" !important.md")) == set(odd[:2])
    deep = ["a/b/c.txt", "c.txt", "a/c.md", "b/", "x/b/y"]
    assert chosen(spark, deep, Selection().include("*.txt")) == {"a/b/c.txt", "c.txt"}
    assert chosen(spark, deep, Selection().include("/c.txt")) == {"c.txt"}
    assert chosen(spark, deep, Selection().include("b/")) == {"a/b/c.txt", "b/", "x/b/y"}
    assert chosen(spark, deep, Selection().include("a/**/c.*")) == {"a/b/c.txt", "a/c.md"}
    assert chosen(spark, ["a1", "a2", "ab"], Selection().include("a[!0-9]")) == {"ab"}


@pytest.mark.parametrize(
    ("length", "given", "expected"),
    [
        (2000, [(0, 200), (250, 500), (900, 1300), (1200, 1600)], [(0, 499), (900, 1599)]),
        (2000, [(0, 200), (700, 900)], [(0, 199), (700, 899)]),
        (3000, [(0, 2500)], [(0, 999), (1000, 1999), (2000, 2499)]),
        (2100, [(1700, 2500)], [(1700, 2099)]),
    ],
)
def test_block_goldens(spark, length, given, expected):
    df = spark.createDataFrame([("a", length, s, e) for s, e in given], "archive string, n long, start long, end long")
    out = spans.plan_blocks(df, block_size=1000, merge_gap=100, length="n")
    assert [(r["start"], r["end"]) for r in out.orderBy("block_id").collect()] == expected


def fold(given, size, gap):
    out = []
    for s, e in sorted(given):
        if out and s - out[-1][1] <= gap and max(out[-1][1], e) - out[-1][0] <= size:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted((p, min(p + size, e) - 1) for s, e in out for p in range(s, e, size))


def test_blocks_against_plain_fold(spark):
    rng, rows = random.Random(5), []
    for a in range(120):
        rows += [(f"a{a}", s := rng.randrange(3000), s + rng.randrange(1, 700)) for _ in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "archive string, start long, end long").cache()
    blocks = spans.plan_blocks(df, block_size=400, merge_gap=60)
    found = {}
    for r in blocks.collect():
        found.setdefault(r["archive"], []).append((r["start"], r["end"]))
    assert {a: sorted(b) for a, b in found.items()} == {a: fold([(s, e) for x, s, e in rows if x == a], 400, 60) for a in {r[0] for r in rows}}
    claims = {(r["archive"], r["block_id"]): r["claims"] for r in spans.block_claims(blocks, df, step=400).collect()}
    for r in blocks.collect():
        assert claims[r["archive"], r["block_id"]] == sum(x == r["archive"] and r["start"] < e and s < r["end"] + 1 for x, s, e in rows)


def test_span_ends(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 50, 100), ("a", 50, 100), ("a", 90, 100)], "archive string, header_offset long, cd_start long")
    assert sorted(r["span_end"] for r in spans.span_ends(df).collect()) == [50, 90, 90, 100]


def test_unions(spark):
    gets = [("a", 0, 9), ("a", 5, 14), ("a", 0, 9), ("b", 10, 20), ("b", 30, 40), ("b", 21, 29), ("b", 41, 50)]
    df = spark.createDataFrame(gets, "k string, start long, end long")
    out = {r["k"]: tuple(r)[1:] for r in intervals.fetch_measures(df, ["k"]).collect()}
    assert out == {"a": (30, 15, 2.0), "b": (41, 41, 1.0)}
    peak = intervals.high_water(spark.createDataFrame([("a", 0, 5), ("a", 4, 9), ("a", 5, 6)], "k string, t0 long, t1 long"), ["k"])
    assert peak.first()["high_water"] == 2


def test_checks(spark):
    df = spark.createDataFrame([("Readme", False), ("README/child.txt", False), ("dir/", True), ("dir/x", False)], "zip_path string, is_directory boolean")
    assert checks.path_collisions(df).count() == 0
    assert {r["zip_path"] for r in checks.path_collisions(df, ignore_case=True).collect()} == {"README/child.txt"}
    same = spark.createDataFrame([("Readme", False), ("README", False)], "zip_path string, is_directory boolean")
    assert checks.path_collisions(same).count() == 0 and checks.path_collisions(same, ignore_case=True).count() == 2
    assert checks.require_unique(df, ["zip_path"], "path").count() == 4
    with pytest.raises(PySparkException):
        checks.require_unique(df.union(df.limit(1)), ["zip_path"], "path").collect()


def test_diagnostics(spark):
    puts = spark.createDataFrame([(1, "SlowDown"), (2, "x"), (1, None), (3, "SlowDown")], "attempt int, error_code string")
    assert diagnostics.put_diagnostics(puts).first().asDict() == {"attempts": 4, "failed_attempts": 3, "retry_attempts": 2, "throttled_attempts": 2, "failures_by_error_code": {"SlowDown": 2, "x": 1}}
    empty = spark.createDataFrame([], "status string")
    assert diagnostics.sync_summary(empty, 0, 0).first()["errors"] == 0
    ops = spark.createDataFrame([("uploaded_new",), ("conditional_conflict",)], "status string")
    row = diagnostics.sync_summary(ops, 2, 1).first()
    assert (row["uploaded_new"], row["conditional_conflicts"], row["errors"]) == (1, 1, 0)
    maps = spark.createDataFrame([("a", {"x": 1}), ("a", {"x": 2, "b": 1})], "k string, failures_by_error_code map<string,long>")
    assert diagnostics.merge_code_maps(maps, ["k"]).first()["failures_by_error_code"] == {"b": 1, "x": 3}
    issues = spark.range(250).select(F.lit("r").alias("run"), "id")
    assert [r["n"] for r in diagnostics.throttled_log(issues, ["id"]).collect()] == [*range(1, 21), 100, 200]


def test_fixtures(spark):
    a, b = (sorted(map(tuple, fixtures.generate(spark, 40, 10_000, seed=9).collect())) for _ in range(2))
    assert a == b and sum(r[4] for r in a) == 10_000 and min(r[4] for r in a) >= 1
    kinds = [r[2] for r in a]
    assert kinds.count("compressible") == 16 and kinds.count("mixed") == 8
    df = spark.createDataFrame([(f"p{i}",) for i in range(41)], "path string")
    assert fixtures.mutate(df, 0.05, 3).where("changed").count() == 3
    assert fixtures.bench_cases(spark, ["f"], ["full", "part"], [128, 256], 3).count() == 12
    assert fixtures.shares(10, [1, 1, 1]) == [4, 3, 3] and fixtures.shares(0, [1, 2]) == [0, 0] and fixtures.shares(7, [0.4, 0.4, 0.2]) == [3, 3, 1]


@pytest.mark.parametrize("total", [0, 1, 999, 10**12 + 7])
def test_largest_remainder(spark, total):
    """Against whole numbers in plain Python, with ties and a last bin that is cut."""
    weights = [(i, 1 + i * i % 7) for i in range(60)] + [(100 + i, 5_000_001) for i in range(5)]
    found = {r["i"]: r["share"] for r in fixtures.largest_remainder(spark.createDataFrame(weights, "i long, w long"), total + 65, ["i"], least=1).collect()}
    whole = sum(w for _, w in weights)
    ranked = sorted(weights, key=lambda x: (-(x[1] * total % whole), -x[1], x[0]))
    left = total - sum(w * total // whole for _, w in weights)
    assert found == {i: 1 + w * total // whole + (k < left) for k, (i, w) in enumerate(ranked)} and sum(found.values()) == total + 65


def test_written_tree(spark, tmp_path):
    """Generated files, and a mutation of the same sizes: digests, kinds and what compresses."""
    rows = fixtures.generate(spark, 40, 2_000_000, seed=4)
    first = {r["path"]: r for r in fixtures.write_tree(rows, str(tmp_path / "t"), 4).collect()}
    kind = {r["path"]: r["kind"] for r in rows.collect()}
    read = {p: (tmp_path / "t" / p).read_bytes() for p in first}
    assert all(len(read[p]) == r["size"] and hashlib.sha256(read[p]).hexdigest() == r["sha256"] for p, r in first.items())
    ratio = lambda k: sum(len(zlib.compress(read[p])) for p in read if kind[p] == k) / sum(len(read[p]) for p in read if kind[p] == k)
    assert ratio("compressible") < 0.5 < ratio("mixed") + 0.25 and ratio("incompressible") > 0.95
    changed = fixtures.mutate(rows, 0.1, 1).where("changed")
    again = {r["path"]: r for r in fixtures.write_tree(changed, str(tmp_path / "t"), 4).collect()}
    assert len(again) == 4 and all(r["size"] == first[p]["size"] and r["sha256"] != first[p]["sha256"] for p, r in again.items())


def test_economics(spark):
    corpus = spark.createDataFrame([("c", 100 * 1024 * 1024 // 8, 8.0, 0.01)], "corpus string, objects long, avg_kib double, access double")
    cost = {r["storage_class"]: r["usd_month"] for r in economics.storage_costs(corpus).collect()}
    assert round(cost["zip_standard"], 2) == 0.63 and round(cost["standard_ia"], 2) == 20.14 and round(cost["glacier_instant"], 2) == 7.74
    assert float(Fraction(128, 8)) == 16.0


def test_fixture_manifests(spark, tmp_path):
    base = fixtures.generate(spark, 12, 600).withColumn("sha256", F.sha2("path", 256)).drop("i")
    row = fixtures.manifest_row(base, 1)
    (tmp_path / "m.json").write_text(row.select(F.to_json(F.struct(*row.columns))).first()[0])
    back = fixtures.read_manifest(spark, str(tmp_path / "m.json"))
    one = back.first()
    assert (one["files"], one["total_size"]) == (12, 600) and sum(c["bytes"] for c in one["classes"].values()) == 600
    entries = fixtures.manifest_entries(back)
    changed = fixtures.mutate(entries.drop("changed"), 0.25, 5).withColumn("sha256", F.when(F.col("changed"), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    assert fixtures.compare_by_position(entries, changed).where("differs").count() == 3
    stats = fixtures.mutation_stats(changed).first()
    assert (stats["changed_files"], stats["unchanged_files"]) == (3, 9)


def test_progress_and_tables(spark):
    ops = spark.createDataFrame([("uploaded_new", 3), ("error", None)], "status string, size long")
    df, seen = diagnostics.observed(ops)
    df.collect()
    assert seen.get["rows"] == 2 and seen.get["uploaded_new"] == 1 and seen.get["bytes"] == 3
    assert diagnostics.markdown_table(ops, ["status"]).splitlines()[2:] == ["| error |  |", "| uploaded_new | 3 |"]


def test_spans_of_one_archive_in_ranges(spark):
    """One archive's rows are dealt to many tasks; bounds, blocks and lookups carry over the ranges."""
    rng = random.Random(7)
    at, rows = 0, []
    for i in range(600):
        at += rng.choice((0, 40, 700))
        rows.append((None if i % 9 == 0 else "a", at, 500_000))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "archive string, header_offset long, cd_start long")
        assert ranges.ranged(df, ["archive"], ["header_offset"]).where("archive = 'a'").select("_part").distinct().count() > 1
        ended = spans.span_ends(df)
        for name in ("a", None):
            offsets = sorted({r[1] for r in rows if r[0] == name})
            after = dict(zip(offsets, [*offsets[1:], 500_000]))
            found = [(r["header_offset"], r["span_end"]) for r in ended.where(F.col("archive").eqNullSafe(F.lit(name))).collect()]
            assert sorted(found) == sorted((r[1], after[r[1]]) for r in rows if r[0] == name)
        pieces = [(s, s + rng.randrange(1, 300)) for s in (rng.randrange(60_000) for _ in range(500))]
        blocks = spans.plan_blocks(spark.createDataFrame([("a", *p) for p in pieces], "archive string, start long, end long"), block_size=400, merge_gap=60)
        expected = fold(pieces, 400, 60)
        assert [(r["start"], r["end"]) for r in blocks.orderBy("block_id").collect()] == expected
        assert sorted(r["block_id"] for r in blocks.collect()) == list(range(1, len(expected) + 1))
        points = spark.createDataFrame([("a", p * 97) for p in range(700)], "archive string, offset long")
        for r in spans.point_to_block(points, blocks).collect():
            last = max((i for i, (s, _) in enumerate(expected, 1) if s <= r["offset"]), default=0)
            assert r["block_id"] == (last if last and r["offset"] <= expected[last - 1][1] else None)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_span_ends_grow_with_the_input(spark):
    """No frame that is gone through anew for each row."""
    df = spark.range(10).select(F.lit("a").alias("archive"), F.col("id").alias("header_offset"), F.lit(99).cast("long").alias("cd_start"))
    plan = spans.span_ends(df)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan


def test_page_groups_are_bounded(spark):
    """Pages are taken in slices of bytes, none of which is lost, also a page larger than a slice."""
    pages = [(i, None if i == 3 else "é" * (i * 13 % 50)) for i in range(40)] + [(99, "x" * 5000)]
    batch = pa.RecordBatch.from_pylist([{"page_id": i, "html": h} for i, h in pages])
    cut = list(roundtrip.slices(batch, 200))
    assert [i for s in cut for i, _ in s] == [i for i, _ in pages] and all(len(s) == 1 or sum(len(h) for _, h in s) <= 200 for s in cut) and len(cut) > 10
    found = roundtrip.pages_roundtrip(spark, spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, len((h or "").encode()), hashlib.md5((h or "").encode()).hexdigest()) for i, h in pages)
