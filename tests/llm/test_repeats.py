"""Repeat removal against brute force."""

import random

import numpy as np
import pytest

from sheaf.llm import repeats
from tests.llm.conftest import SCHEMA, sha


def brute(raws, window):
    seen = {}
    for r in raws:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] = seen.get(r[i : i + window], 0) + 1
    return [np.array([seen[r[i : i + window]] > 1 for i in range(max(0, len(r) - window + 1))], bool) for r in raws]


@pytest.mark.parametrize(("window", "step", "shards"), [(8, 1, 2), (8, 4, 3), (12, 3, 1), (10, 10, 5), (6, 2, 9)])
def test_merged_transforms_find_repeats(window, step, shards):
    rng = random.Random(window * step)
    for _ in range(30):
        raws = [bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 12))]
        found = repeats.repeated_windows(raws, window=window, step=step, shards=shards)
        for a, b in zip(found, brute(raws, window)):
            assert np.array_equal(a, b)


def test_merge_gives_order_and_common_prefixes():
    raws = [b"banana", b"bandana", b"ananas", b"band"]
    symbol, after, before, string, *_ = repeats._suffixes(raws, 1)
    orders, parts = [], []
    for low, high in ((0, np.searchsorted(string, 2)), (np.searchsorted(string, 2), len(symbol))):
        order = repeats._order(symbol[low:high], after[low:high] - low, 8) + low
        orders.append(order)
        parts.append(before[order])
    turn, lcp = repeats.merge(parts, 8)
    at, merged = [0, 0], []
    for t in turn:
        merged.append(int(orders[t][at[t]]))
        at[t] += 1

    def suffix(e):
        out = []
        while symbol[e]:
            out.append(int(symbol[e]))
            e = int(after[e])
        return out

    found = [suffix(e) for e in merged]
    assert found == sorted(found)
    for a, b, n in zip(found, found[1:], lcp[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == common or (a == b and n == 8)


def removal(texts):
    raws = [(t or "").encode() for t in texts]
    out = []
    for r, flags in zip(raws, brute(raws, 200)):
        mark = np.zeros(len(r) + 1, int)
        for i in np.flatnonzero(flags):
            mark[i] += 1
            mark[i + 200] -= 1
        hit = np.cumsum(mark)[:-1] > 0
        out.append((len(r), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), sha(bytes(b for b, h in zip(r, hit) if not h))))
    return out


@pytest.mark.parametrize("many", [2_000, 1])
def test_documents(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefg ", k=n))
    shared = [text(n) for n in (199, 200, 201, 260, 500)]
    texts = [text(rng.randrange(0, 400)) + rng.choice(shared) + text(rng.randrange(0, 300)) + rng.choice(shared) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "é" * 150, "é" * 150, "ab" * 400, text(50) + texts[1] + "x"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, chunk_bytes=5_000).collect()}
    assert [out[i] for i in range(len(texts))] == removal(texts)


@pytest.mark.parametrize("far", [8_388_608, 20_000_000])
def test_passage_far_into_a_text(spark, far):
    rng = np.random.default_rng(5)
    text = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    shared = text(450)
    texts = [text(far - 300) + shared + text(700) + shared[:230] + text(50), text(100) + shared + text(30)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in repeats.remove_repeats(df).collect()}
    assert out == {0: [(far - 300, far + 150), (far + 850, far + 1080)], 1: [(100, 550)]}


def test_least_places():
    h = np.random.default_rng(6).integers(0, 40, 300).astype(np.uint64) << np.uint64(50)
    for span in (1, 7, 161):
        assert repeats._least_places(h, span).tolist() == [i + int(np.argmin(h[i : i + span])) for i in range(len(h) - span + 1)]


def test_occurrences_count():
    raws = [b"abcdefgh", b"xbcdefgz"]
    assert [f.tolist() for f in repeats.repeated_windows(raws, times=[1, 1], window=6, step=2)] == [[False, True, False], [False, True, False]]
    assert [f.tolist() for f in repeats.repeated_windows(raws, times=[3, 1], window=6, step=2)] == [[True] * 3, [False, True, False]]


@pytest.mark.parametrize("most", [64, 300, 1_000])
def test_stretches_change_nothing(most):
    """The windows of a text, whatever the stretches: each once, with the same gram."""
    rng = random.Random(most)
    text = "".join(rng.choices("abc é", k=2_500))
    windows = {}
    for held in repeats._stretches([None, text, "ab" * 150, ""], most):
        part, h, _, s, n, _ = repeats.runs([raw for _, _, raw in held])
        for p, g, first, many in zip(part.tolist(), h.tolist(), s.tolist(), n.tolist()):
            for w in range(first, first + many):
                assert windows.setdefault((held[p][0], held[p][1] + w), g) == g
    assert sorted(windows) == [(1, i) for i in range(len(text.encode()) - 199)] + [(2, i) for i in range(101)]
    whole = repeats.runs([text.encode()])
    assert all(windows[1, s + i] == h for _, h, _, s, n, _ in zip(*(x.tolist() for x in whole)) for i in range(n))


def test_odd(spark, odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == by[1]["n_bytes"] and by[4]["n_bytes"] == 0 and by[10]["n_removed"] == 70_000 and by[7]["n_removed"] == 60_000
    assert repeats.remove_repeats(empty).count() == 0
