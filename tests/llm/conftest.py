from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Words of an invented language, so that texts look like prose.
PARTS = ["ka", "lo", "mi", "ten", "dar", "us", "ver", "o", "shi", "pal"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w if rng.random() < 0.7 else rng.choice(["the", "of", "and", "der", "la"]) for w in words)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text, lang, source) tuples, longer ones as they come."""
    def build(rows, **extra):
        data = [(*(list(r) + [None] * (4 - len(r)))[:4], len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(data, SCHEMA).repartition(3)
        from pyspark.sql import functions as F
        return frame.withColumns({k: F.lit(v) for k, v in extra.items()})
    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Missing and empty texts, white space, a very long text, ties, repeated rows, missing
    ids and sources, and columns named like those the operators use themselves.
    """
    rows = [(k, prose(k, 40 + k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(12)]
    rows += [(20, None, None, None), (21, "", "en", "s0"), (22, " \t\n", "en", "s1"),
             (23, prose(3, 43), "de", "s2"), (24, prose(3, 43) + " kalo", None, "s0"),
             (25, prose(99, 40_000), "en", "s0"), (26, "a", "en", "s1"), (27, "!!! 123", "de", None),
             (None, prose(7, 47), "en", "s1"), (None, None, None, None),
             (5, prose(5, 45), "en", "s2"), (5, prose(5, 45), "en", "s2"), (5, prose(6, 30), "en", "s2")]
    return documents(rows, size=1, score="x", row=2.0, h=3, key="k", rank=4, fp=5, part="p",
                     n_tokens=6, copies=7, spans="s", did=8, cell=9, label=True)
