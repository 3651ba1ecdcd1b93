import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, words="abcdefgh"):
    return " ".join("".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(rng, 70, "xyzuvw")
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "Word", "en", "b", 4), (5, "wORD", "en", "b", 4),
        (6, base, "en", "a", 9), (7, base.upper(), "en", "a", 9), (8, " ".join(near), "en", "b", 9),
        (9, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "en", "c", 9), (10, prose(rng, 40) + " " + passage, "en", "c", 9),
        (11, prose(rng, 30000), "en", "c", 9), (12, "é" * 900 + "\n" + "ß" * 10, "de", "c", 9), (12, "é" * 900 + "\n" + "ß" * 10, "de", "c", 9),
        (None, "no id here", "en", "a", 1), (13, "one two", "en", "a", 1), (14, "<|endoftext|> don't 123 ¡olé!", "es", "a", 1), (15, "same line\n" * 50, "en", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with extra columns whose names clash with those the operators make."""
    df = spark.createDataFrame(odd_rows, SCHEMA)
    from pyspark.sql import functions as F

    names = ["score", "kept", "digest", "size", "target", "copies", "label", "_rid", "_size", "_norm", "slot", "shard", "length", "start", "part", "n", "id", "component", "bands", "rank", "task", "g", "keys"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
