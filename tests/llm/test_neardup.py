"""Near duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import common, neardup
from sheaf.llm.components import components
from tests.llm.conftest import SCHEMA


def brute(texts, percent=85):
    sets = [set(s.tolist()) for s in neardup.shingle_sets(texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def test_against_brute_force(spark):
    rng, texts = random.Random(8), []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 250))]
        chain = base
        for _ in range(rng.randrange(1, 12)):
            texts.append(" ".join(edited(rng, chain, rng.randrange(0, 4))))
            chain = edited(rng, chain, rng.randrange(0, 2)) if rng.random() < 0.5 else base
    # one group of many near copies whose smallest id is not its hub
    base = [f"h{rng.randrange(300)}" for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randrange(0, 8))) for _ in range(150)]
    texts += [texts[3].upper(), texts[3], None, "", " \n", "one two", "one  two", "One two three four"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    comp, sizes = brute(texts)
    assert [rows[i]["component_id"] for i in range(len(texts))] == comp
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.values())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:180], rng.integers(0, 2**63, 20).astype(np.uint64)])
    sig = neardup.signatures([np.unique(a), np.unique(b), np.unique(a[:7])], neardup._donors())
    assert abs((sig[0] == sig[1]).mean() - 180 / 220) < 0.12
    assert set(sig[2].tolist()) <= set(a[:7].tolist())
    assert (neardup.signatures([np.unique(a)], neardup._donors()) == sig[:1]).all()


def test_links_from_80(spark):
    """4 in 5 and 5 in 6 shingles, 0.80 to 0.849 in longer texts, and pairs below 0.80."""
    rng, texts = random.Random(12), []
    fresh = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    for n in [8] * 20 + [9] * 20 + [12] * 20 + [44] * 40 + [84] * 40:
        base = fresh(n)
        more = {8: 1, 9: 1, 12: 1, 44: 10, 84: 20}[n]  # appended words: n - 4 shingles in n - 4 + more
        texts += [" ".join(base), " ".join(base + fresh(more)), " ".join(fresh(2) + base[1:] + fresh(more))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    comp, _ = brute(texts, 80)
    assert len(set(comp)) < len(set(brute(texts, 85)[0]))
    assert {r["doc_id"] for r in neardup.deduplicate(df, percent=80).collect()} == set(comp)


@pytest.mark.parametrize("shares", [1000, 3])
def test_loosely_similar_group(spark, monkeypatch, shares):
    """Texts with a common part of three quarters, of which few pairs are linked, and by leaves only;
    with few shares, the hot keys are taken by broadcast."""
    monkeypatch.setattr(common, "SHARES", shares)
    rng = random.Random(21)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    base, pool, texts = fresh(120), [fresh(30) for _ in range(12)], []
    for _ in range(400):
        tail = edited(rng, rng.choice(pool), rng.randrange(0, 5))
        texts.append(" ".join(edited(rng, base, rng.randrange(0, 2)) + tail))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    comp, _ = brute(texts)
    assert 12 <= len(set(comp)) < 400
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(texts))] == comp


def test_residual_links_alone(spark):
    """The second search finds all links without any star."""
    rng, texts = random.Random(5), []
    for _ in range(40):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(8, 120))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = df.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), F.lit(7).cast("long").alias("g"))
    found = {r["id"]: r["component"] for r in components(neardup.residual_links(nodes, df, 85, least=16, most=40)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == brute(texts)[0]


def test_recall_on_small_sets():
    """Pairs at or a little above the threshold with 6 to 30 shingles, where nearly all bins borrow."""
    rng, donors, missed, pairs = np.random.default_rng(7), neardup._donors(), 0, 0
    for n in range(6, 31):
        for _ in range(120):
            union = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            lost = n * 15 // 100  # of n in the union
            if not lost:
                continue
            a, b = np.unique(union[lost // 2 :]), np.unique(np.delete(union, np.arange(lost // 2, lost)))
            keys = neardup.band_keys(neardup.signatures([a, b], donors))
            pairs, missed = pairs + 1, missed + (not (keys[0] == keys[1]).any())
    assert pairs > 2_500 and missed <= 2


def test_bands_follow_the_threshold():
    assert [(neardup.bands_for(p), neardup.least_for(p)) for p in (85, 80)] == [(36, 6), (63, 4)] and neardup.least_for(100) is None


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_components_by_one_task_and_by_rounds(spark, most):
    """Both ways against plain Python: chains with shuffled ids, stars, loops, repeated and reversed edges."""
    rng, ids = random.Random(9), random.Random(10).sample(range(-(10**12), 10**12), 400)
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[70], ids[70 + i]) for i in range(1, 50)] + [(max(ids), ids[130 + i]) for i in range(40)]
    edges += [(ids[rng.randrange(200, 400)], ids[rng.randrange(200, 400)]) for _ in range(110)] + [(ids[5], ids[5]), (ids[199], ids[199])]
    edges += edges[:20] + [(v, u) for u, v in edges[60:90]]
    comp = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(comp[u] != comp[v] for u, v in edges if u != v):
        for u, v in edges:
            if u != v:
                comp[u] = comp[v] = min(comp[u], comp[v])
    rows = components(spark.createDataFrame(edges, "u long, v long"), most=most).collect()
    assert len(rows) == len(comp) and {r["id"]: r["component"] for r in rows} == comp
    assert components(spark.createDataFrame([], "u long, v long"), most=most).collect() == []


def test_few_edges_cost_the_driver_few_jobs(spark):
    """A chain of 300 edges took dozens of jobs, each with tasks by the number of partitions."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        assert {r["component"] for r in components(chain).collect()} == {0}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 6


def test_odd(spark, odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 1 and by[4]["kept"] and by[5]["kept"] and by[9]["n_shingles"] == 0
    kept = neardup.deduplicate(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(8) == 1 and None in ids and 2 not in ids
    assert neardup.near_duplicates(empty).count() == 0
