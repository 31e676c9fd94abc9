"""Phrase and proximity matches against brute force."""

import random
from collections import Counter

from sheaf.llm import decontaminate as d
from tests.llm.conftest import SCHEMA, sha


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = d.tokens(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out, often = [], Counter(x for t in texts for x in d.tokens(t))
    for t in texts:
        w, hit, found, near = d.tokens(t), set(), set(), set()
        for win, names in windows.items():
            rare = min(win, key=lambda x: (often[x], win.index(x)))
            if any(x == rare and set(win) <= set(w[max(0, i - 20) : i + 21]) for i, x in enumerate(w)):
                near |= names
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return out


def made():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["É", "x9", "Ünï"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(0, 40))) for i in range(20)] + [(20, "tiny item"), (21, None), (22, "..."), (23, "w1 w1"), (120, "tiny item")]
    texts = []
    for _ in range(80):
        w = d.tokens(rng.choice(items)[1])
        at = rng.randrange(0, max(1, len(w)))
        if rng.random() < 0.2:
            w = rng.sample(w, len(w))  # near, not exact
        texts.append(f"{text(rng.randrange(0, 60))}, {' '.join(w[at : at + rng.randrange(5, 30)]).upper()}; {text(rng.randrange(0, 30))}")
    return [*texts, "", None, "!!!", "tiny-item TINY item", "w1 w1 w1 w1"], items


def test_phrases(spark):
    texts, items = made()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([*items, (None, "w1 w2")], "item_id long, text string")
    for block in (2_000_000, 60):
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near"]) for r in d.decontaminate(docs, bench, block_words=block).collect()}
        assert [rows[i] for i in range(len(texts))] == brute(texts, items)
    assert any(r[5] > r[2] for r in rows.values())
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in enumerate(brute(texts, items)) if not x[4]}


def test_rows_are_dropped_by_their_own_text(spark):
    rows = [(None, "ab ab ab"), (None, "clean text"), (None, None), (1, "ab ab"), (1, "clean text"), (2, "ab ab"), (2, "ab ab"), (3, "clean text"), (3, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = d.drop_contaminated(docs, spark.createDataFrame([(1, "ab ab")], "item_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[1] is None or r[1].startswith("clean"))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "gamma x beta x alpha", "en", "s", 1), (2, "alpha " + "x " * 30 + "beta gamma", "en", "s", 1), (3, None, "en", "s", 1)], SCHEMA)
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    q = d.Queries([("7", "alpha beta gamma")])
    index = d.build_index(docs, d.term_bitmap(bench))
    freq = d.term_frequencies(index, q)
    assert [tuple(r) for r in d.proximity_hits(index, q, freq, 5).collect()] == [(1, "7")]
    assert all(not r["items"] for r in d.phrase_hits(index, q, q.plan(freq)).collect())


def test_ids_of_any_type_and_long_items(spark):
    """Text ids, an item longer than a block, a very long document, and clashing column names."""
    rng = random.Random(8)
    long = " ".join(f"k{rng.randrange(900)}" for _ in range(3_000))
    w = long.split()
    docs = spark.createDataFrame(
        [("a", " ".join(w[500:560]), 1, 2), ("b", "clean text", 3, 4), (None, " ".join(w[2_980:]), 5, 6), ("c", "lead " * 300_000 + " ".join(w[90:110]), 7, 8)], "doc_id string, text string, __uid long, uid long"
    )
    bench = spark.createDataFrame([("long one", long), ("short, one", "lead lead"), (None, "clean text")], "item_id string, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in d.decontaminate(docs, bench, block_words=100).collect()}
    assert found == {"a": (60, 60, 1, sha(b"long one")), "b": (2, 0, 0, sha(b"")), None: (20, 20, 1, sha(b"long one")), "c": (300_020, 300_020, 2, sha(b"long one,short, one"))}
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [("b", "clean text", 3, 4)]


def test_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "ab ab")], "item_id long, text string")
    rows = d.decontaminate(odd, bench).collect()
    assert len(rows) == odd.count() and {r["doc_id"] for r in rows if r["contaminated"]} == {7}
    two = spark.createDataFrame([(1, "ab ab"), (2, "river stone light under never always before small great house of the and")], "item_id long, text string")
    one_block, blocks = (sorted(map(tuple, d.decontaminate(odd, two, block_words=n).collect()), key=lambda r: (r[0] is None, r)) for n in (1000, 1))
    assert one_block == blocks and len(blocks) == odd.count()
    assert d.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in d.decontaminate(odd, bench.limit(0)).collect())
