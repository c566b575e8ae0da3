"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is on by it or be at as for was with that this are from".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "ed", "ly"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with every odd case."""
    rng = random.Random(5)
    passage = sentence(rng, 70)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, "one", "en", "b", 3), (5, "One  two", "de", "b", 8), (6, "one two", "de", None, 7),
        (7, sentence(rng, 4000), "en", "c", 0), (8, "Straße éàü 漢字 𝒳𝒴", "de", "c", 0), (9, "x" * 5000, "fr", "c", 5000), (10, "a b c d e", "en", "a", 9), (10, "a b c d e", "en", "a", 9), (11, "a b c d e", "en", "zz", 9),
        (12, sentence(rng, 30) + " " + passage + " " + sentence(rng, 40), "en", "a", 0), (13, sentence(rng, 55) + " " + passage + " " + sentence(rng, 20), "en", "b", 0),
    ]
    rows += [(100 + i, sentence(rng, 40 + 3 * i), rng.choice(["en", "de"]), rng.choice("abc"), i) for i in range(40)]
    rows += [(300 + i, rows[20][1] + " " * (i % 3), "en", "hot", i) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The odd rows with a null id, and extra columns named like what operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*odd_rows, (None, "no id here", "en", "a", 1)], SCHEMA)
    names = ["_id", "_t", "_row", "kept", "keep_id", "size", "slot", "shard", "bucket", "_fp", "score", "source_size", "ranges", "_key", "_n", "fingerprint", "held_out"]
    return df.select("*", *[F.lit(1).alias(n) for n in names]).repartition(3).cache()
