import hashlib
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and a clashing column."""
    rng = random.Random(3)
    words = "the of and shed river stone light under never always before small great house".split()
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = para(300)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " one more word here", None, None, None), (4, None, "en", "a", 0), (5, "", None, "b", 0),
        (6, "x", "en", "b", 1), (7, "ab " * 20_000, "en", "b", 60_000), (8, para(40), "de", "c", 5), (8, para(40), "de", "c", 5), (None, para(60), None, None, None),
        (9, "\n\t \r", "en", None, 4), (10, "a" * 70_000, "en", "c", 70_000), (11, "ÄÖ ñ 日本語 " * 30, "fr", "a", 9),
    ]
    rows += [rows[7]]
    return spark.createDataFrame([(*r, f"extra{i}") for i, r in enumerate(rows)], SCHEMA + ", size string").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
