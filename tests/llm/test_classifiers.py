"""Quality and toxicity scores: held-out accuracy, calibration and odd input."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import calibrate, quality, toxicity
from sheaf.llm.common import table

SF = "/root/testdata/sf0.01"


def test_pool_adjacent():
    assert calibrate.pool_adjacent([(1, 0), (1, 1), (1, 0), (0, 0), (2, 2)]) == [0, 0.5, 0.5, 0.5, 1]
    rng = random.Random(1)
    bins = [(float(n := rng.randrange(0, 9)), float(rng.randrange(0, n + 1))) for _ in range(50)]
    out = calibrate.pool_adjacent(bins)
    assert len(out) == 50 and out == sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    labels = table(spark, SF, "labels").select("doc_id", label)
    out = module.score_documents(table(spark, SF, "documents"), labels)
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_lexicon_and_obfuscation():
    lexicon = toxicity.Lexicon({"moron": 6.0, "lowei*": 5.0})
    at = dict(zip(toxicity.FEATURES, toxicity.features(["You are a Moron, du loweischaft m0ron m.o.r.o.n"], lexicon)[0]))
    assert at["top"] == 6 and at["hits"] == 2 and at["distinct"] == 2 and at["near_you"] > 0 and at["obfuscated"] >= 2
    assert set(toxicity.features([None], lexicon)[0]) == {0.0}
    long = "x" * 90 + "m0ron" + "y" * 90  # long obfuscated words are read whole
    assert toxicity.features([long + " " + "z1" * 60 + "!moron"], toxicity.Lexicon({"x" * 90 + "moron" + "y" * 90: 9.0}))[0][11] == 1


def plain_features(text, weights):
    """The dense features, word by word."""
    text = text or ""
    weigh = lambda w: max([weights.get(w, 0.0), *[weights.get(w[:n] + "*", 0.0) for n in (4, 5, 6) if len(w) > n]])
    lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    spans = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W\d_]+", text)]
    words = [w for _, _, w in spans]
    hits = [(i, weigh(lower(w))) for i, w in enumerate(words) if weigh(lower(w)) > 0]
    you = [i for i, w in enumerate(words) if lower(w) in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in you) for i, _ in hits)
    read = lambda t: "".join(toxicity.LEET.get(c, c) for c in lower(t))
    mixed = hidden = 0
    for token in text.split():
        if re.search(r"[0-9@$!][^\W\d_]", token):
            mixed += 1
            found = toxicity.WORD.findall(read(token))
            hidden += any(weigh(w) >= 4.0 for w in [*found, "".join(found)])
    run = []
    for k, (a, b, w) in enumerate([*spans, (0, 9, "")]):
        if len(w) == 1 and run and a == run[-1][1] + 1 and text[a - 1] in ".-*_ ":
            run.append((a, b, w))
            continue
        if len(run) >= 4:
            mixed += 1
            hidden += weigh(lower("".join(x for _, _, x in run))) >= 4.0
        run = [(a, b, w)] if len(w) == 1 else []
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda chars: sum(text.count(c) for c in chars) / size
    shout = sum(len(w) > 2 and all(c.isupper() for c in w) for w in words)
    return [
        max((w for _, w in hits), default=0.0), sum(w for _, w in hits), len(hits), len(hits) / n, len({lower(words[i]) for i, _ in hits}), near / n, len(you) / n, shout / n,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(".,;:?!\"'()-*#%&$|"), share("!"), hidden, mixed / n, np.log1p(len(words)),
    ]


def test_features_against_plain_version():
    rng = random.Random(6)
    stock = "you DU tes moron M0R0N m.o.r.o.n m-o r o n a I i d i o t Ärger ÄRGER loweischaft löwe2x x3y 12 4u $a!l ... ' -- |x| 日本 ß İstanbul\t\n idiot! idi0t,so not_me".split(" ")
    weights = {"moron": 6.0, "idiot": 4.5, "lowei*": 5.0, "ärge*": 2.0, "so": 1.0}
    texts = [None, "", " ", "\n", *[" ".join(rng.choice(stock) for _ in range(rng.randrange(1, 60))) for _ in range(300)]]
    found = toxicity.features(texts, toxicity.Lexicon(weights))
    for text, row in zip(texts, found):
        assert np.allclose(row, plain_features(text, weights)), text
    # the same in many groups, and a long text in pieces
    long = " ".join(rng.choice(stock) for _ in range(120_000))
    cut = toxicity.features([*texts, long], toxicity.Lexicon(weights))
    assert np.allclose(cut[:-1], found) and np.allclose(np.delete(cut[-1], [5, 11, 12]), np.delete(np.array(plain_features(long, weights)), [5, 11, 12]))
    assert len(toxicity.pieces(long)) > 2 and "".join(toxicity.pieces(long)) == long


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd(spark, odd, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (7, 0, 1), (8, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 1")):
        rows = module.score_documents(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert module.score_documents(empty, labels).count() == 0


def test_drop_toxic_keeps_columns(spark, odd):
    rows = [(i, f"plain text number {i} and more", 0) for i in range(60)] + [(100 + i, f"you are a moron number {i}", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], "doc_id long, text string, top string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.select(F.col("doc_id")).collect()} == set(range(60))


def test_quality_against_plain_numpy(spark):
    """Standardising, the cosine map, the ridge fit and the isotonic levels, without Spark."""
    rng = random.Random(14)
    words = "the of and shed river stone light under never always before small great house".split()
    rows = []
    for i in range(400):
        good = i % 2
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60))) if good or rng.random() < 0.1 else "".join(rng.choice("#$%& !!||ab") for _ in range(rng.randrange(50, 300)))
        rows.append((i, text, good))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seed, size = 17, 64
    found = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels, size=size, seed=seed).collect()}
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)).alias("p")).collect()}
    x = np.array([quality.statistics(t) for _, t, _ in rows])
    y = np.array([float(v) for *_, v in rows])
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows])
    fit, cal = learn & np.array([part[i] != 0 for i, *_ in rows]), learn & np.array([part[i] == 0 for i, *_ in rows])
    kernel = quality.Kernel(x[fit].mean(0), x[fit].std(0), size, seed)
    z = kernel(x)
    beta = np.linalg.solve(z[fit].T @ z[fit] + np.diag([1e-6] + [1.0] * (z.shape[1] - 1)), z[fit].T @ y[fit])
    raw = np.clip(z @ beta, 0, 1)
    at = np.minimum(calibrate.BINS - 1, np.floor(raw * calibrate.BINS).astype(int))
    levels = calibrate.pool_adjacent([(float((cal & (at == b)).sum()), float(y[cal & (at == b)].sum())) for b in range(calibrate.BINS)])
    want = np.array(levels)[at] * 0.98 + raw * 0.02
    assert np.mean(np.abs(want - np.array([found[i] for i, *_ in rows])) < 1e-6) > 0.99  # a score on a bin's edge may fall either way
