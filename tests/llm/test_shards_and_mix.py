"""Sharding and mixing: laws, reruns and odd input."""

import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import common, mixing, sharding
from sheaf.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_shards(spark):
    docs = table(spark, SF, "documents")
    rows = sharding.shard(docs, leaves=16).collect()
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(7), leaves=16).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows} and len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes, where = Counter(), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        sizes[r["shard"]] += r["size"]
        assert where.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) < 1.1 * min(sizes.values())
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.leaves_for(1000, 300) == 4 and sharding.leaves_for(0, 300) == 1


def test_shards_against_brute_force(spark, monkeypatch):
    """Each row lies on its side of every cut, cuts halve the weight as far as one point allows, and
    equal texts stay together though their metadata differ and one text has a third of all rows."""
    monkeypatch.setattr(common, "SHARES", 20)
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 25)
    rng = random.Random(9)
    rows = [(i, "x" * (1 + int(2 ** rng.uniform(0, 12))) + str(i), rng.choice(["de", "en", None]), f"s{rng.randrange(30)}") for i in range(600)]
    rows += [(1000 + i, "the one text of many", rng.choice(["de", "en", None]), f"s{rng.randrange(30)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard(docs, leaves=8).collect()
    assert sorted((r["doc_id"], r["lang"], r["source"]) for r in out if r["lang"]) == sorted((r[0], r[2], r[3]) for r in rows if r[2]) and len(out) == len(rows)
    shard = {r["doc_id"]: r["shard"] for r in out}
    assert len({shard[i] for i in range(1000, 1300)}) == 1
    points = docs.select("source", "lang", sharding.doc_size(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), "doc_id").where("doc_id < 600").withColumn("w", F.col("size"))
    space = sharding.kd_tree(points.select("h", "source", "lang", "size", "w"), 8)
    placed = space.steps(points).select("*", space.leaf().alias("leaf")).collect()
    for level, cuts in enumerate(space.cuts):
        for node, (axis, step, tie) in cuts.items():
            inside = [r for r in placed if r["leaf"] >> 3 - level == node]
            upper = [r for r in inside if (r[axis], r["tie"]) >= (step, tie)]
            assert {r["doc_id"] for r in upper} == {r["doc_id"] for r in inside if r["leaf"] >> 2 - level & 1}
            assert abs(2 * sum(r["w"] for r in upper) - sum(r["w"] for r in inside)) <= max(r["w"] for r in inside)
            width = lambda rs, d: max(r[d] for r in rs) - min(r[d] for r in rs)
            spread = {d: width(inside, d) / max(1, width(placed, d)) for d in sharding.DIMS}
            assert spread[axis] == max(spread.values())
    steps = {r["source"]: r["d_source"] for r in placed}
    assert [steps[s] for s in sorted(steps)] == sorted(set(steps.values())) and max(steps.values()) == sharding.STEPS - 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_odd_shards(spark, odd, empty):
    rows = sharding.shard(odd, leaves=4, keep=("text", "size")).collect()
    assert len(rows) == odd.count() and {r["doc_size"] for r in rows} == {r["size"] for r in odd.collect()}
    assert next(r for r in rows if r["doc_id"] == 4)["size"] == 1
    assert sharding.shard(empty).count() == 0
    assert {r["shard"] for r in sharding.shard(odd, leaves=None, target_bytes=10**9).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shard(odd, leaves=3).count()


def test_reshare():
    sizes, weights = [10, 1000, 1000, 0], [3.0, 1.0, 2.0, 3.0]
    out = mixing.reshare(sizes, weights, 1.5, 2.0)
    assert out[0] == 20 and out[3] == 0 and abs(sum(out) - 1.5 * 2010) < 1e-6 and all(t <= 2 * s for t, s in zip(out, sizes))
    assert mixing.reshare([], [], 1.5, 2) == [] and mixing.reshare([0], [1.0], 1.5, 2) == [0]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_mix(spark):
    docs = table(spark, SF, "documents")
    out, slots = mixing.mix(docs)
    rows = out.collect()
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5))[0].collect()} == {(r["doc_id"], r["taken"]) for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(words(text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items()) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    drawn = [tuple(r) for r in slots.collect()]
    assert len({x[2:] for x in drawn}) == len(drawn)  # every place of the mix holds one block
    uses = Counter(x[:2] for x in drawn)
    for s in target:
        n = [uses.get((s, b), 0) for b in range(-(-size[s] // 64))]
        assert max(n) - min(n) <= 1
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    got = Counter()
    for r in made.collect():
        got[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == +taken


def sparks_hash(*values):
    """Spark's xxhash64 of 32-bit (tagged), 64-bit, text and null values."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, *keys):
    key = sparks_hash(*keys)
    for r in range(6):
        other = (sparks_hash(key, (r,)) % n - x) % n
        if sparks_hash(max(x, other), key, (r + 1000,)) & 1:
            x = other
    return x


@pytest.mark.parametrize("slots", [[700, 0, 300, 555], [40], [3, 900], [1, 1, 1]])
def test_draw_against_plain_python(spark, slots):
    """Every slot of the mix, from the picks on, in plain Python."""
    names, blocks, shard_slots, seed = ["a", "bü", "c", None], [500, 0, 200, 300], 128, 11
    plan = [{"no": i, "source": names[i], "source_size": 0, "target": 0.0, "n_blocks": blocks[i] or 1, "slots": s} for i, s in enumerate(slots)]
    found = {(r["out_shard"], r["out_slot"]): (r["source"], r["block"]) for r in mixing.draw_slots(spark, plan, shard_slots=shard_slots, seed=seed).collect()}
    n, m = sum(slots), len(slots)
    keep, other = mixing.alias_table(slots)
    for c in range(m):  # the table is exact
        assert sum(keep[j] if j == c else 0 for j in range(m)) + sum(n - keep[j] for j in range(m) if other[j] == c and keep[j] < n) == slots[c] * m
    counts = defaultdict(Counter)
    for x in range(n):
        c, v = sparks_hash((seed,), x, (0,)) % m, sparks_hash((seed,), x, (1,)) % n
        counts[x // shard_slots][c if v < keep[c] else other[c]] += 1
    nth, places = Counter(), []
    for shard in sorted(counts):
        ahead = 0
        for no in range(m):
            for _ in range(counts[shard][no]):
                places.append([no, nth[no], shard, ahead])
                nth[no], ahead = nth[no] + 1, ahead + 1
    short = [(no, i) for no in range(m) for i in range(nth[no], slots[no])]
    beyond = sorted((p for p in places if p[1] >= slots[p[0]]), key=lambda p: (p[0], p[1]))
    assert len(short) == len(beyond)
    for p, (no, i) in zip(beyond, short):
        p[:2] = no, i
    want = {}
    for no, i, shard, at in places:
        b = plan[no]["n_blocks"]
        at = permuted(at, min(shard_slots, n - shard * shard_slots), (seed + 1,), shard)
        want[shard, at] = (names[no], permuted(i % b, b, (seed,), names[no], i // b))
    assert found == want and len(want) == n
    assert Counter(s for s, _ in found.values()) == +Counter({names[i]: s for i, s in enumerate(slots)})


def test_mix_keeps_clashing_columns(spark):
    names = ["uid", "copy", "size", "_uid", "pass", "parts", "_u"]
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(12)], ", ".join(["doc_id long, text string, source string", *[f"{n} string" for n in names]]))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)


def test_odd_mix(spark, odd, empty):
    rows = mixing.mix(odd)[0].collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_repeated_rows_in_the_mix(spark):
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("n", 150), "a", "x")] * 2 + [(1, text("o", 100), s, e) for s, e in (("a", "x"), ("a", "y"), ("b", "x"), (None, "x"))]
    rows += [(i, text(f"r{i}_", 70), "abc"[i % 3], "z") for i in range(2, 20)] + [(30, None, "a", "x")] * 2 + [(31, " ", "b", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    got, taken = Counter(), Counter()
    for r in mixing.mixed_documents(docs, block_words=16).collect():
        w = words(r["text"])
        assert w and len(set(w)) == len(w)
        got[r["doc_id"], r["source"]] += len(w)
    for r in mixing.mix(docs, block_words=16)[0].collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    assert got == +taken
    again = [sorted(map(str, mixing.mixed_documents(docs.repartition(n, "extra"), block_words=16).collect())) for n in (1, 5)]
    assert again[0] == again[1]
