import random

import pytest

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu", "ne") for b in ("la", "mi", "so", "ve") for c in ("n", "ra", "st", "po", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    """About n words in sentences."""
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 12))
        out.append(" ".join(rng.choices(WORDS, k=k)).capitalize() + rng.choice([".", ".", "!", "?"]))
        n -= k
    return " ".join(out)


def table(spark, texts, extra=""):
    """Documents 0, 1, ... of the texts; some columns that operators must not trip over."""
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t) if t is not None else None, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", _stats string, n_removed long")


ODD = [None, "", " \n\n ", "...", "word", "x" * 300_000, "a b " * 30_000, "ß İ ☃ \U0001f600 x", "same text. here.", "same text. here."]


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def odd(spark):
    df = table(spark, ODD)
    return df.unionByName(spark.createDataFrame([(None, "No id here. None at all.", "en", "s0", 24, "x", 1), (0, None, None, None, None, None, None)], df.schema))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
