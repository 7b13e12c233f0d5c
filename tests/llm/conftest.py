import random

import pytest

#: Names that operators use inside, or return: extra columns of an input may be called so.
CLASHING = ["size", "shard", "node", "band", "score", "label", "n", "mark", "id", "block", "weight", "start", "x", "items", "value", "kind", "seen", "_start"]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n)]


def documents(spark, rows, clash=False):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, texts beyond ASCII."""
    a = " ".join(words(1, 60))
    near = a.rsplit(" ", 2)[0] + " other end"
    return [
        (1, a, "en", "s1"), (1, a, "en", "s1"), (2, a, "en", "s1"), (3, near, "de", "s2"), (4, None, "en", "s1"), (5, "", "en", None),
        (6, " \t\n ", None, None), (None, a, "en", "s1"), (None, None, None, None), (7, "one two", "fr", "é"), (8, "ONE two", "fr", "é"),
        (9, "one  two \n", "fr", "é"), (10, " ".join(words(2, 30_000)), "en", "s1"), (11, "x" * 200_000, "en", "s2"),
        (12, "naïve Ünïcode 𝒳 words", "es", "s3"), (13, " ".join(words(3, 50)), "en", "s3"), (13, " ".join(words(4, 50)), "en", "s3"),
        (14, "1 " * 5000, "en", "s3"), (15, "....,,,,!!!!", None, "s3"),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return documents(spark, odd_rows, clash=True)


@pytest.fixture
def none(spark):
    return documents(spark, [], clash=True)


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 16)] + [(3, None, None), (None, 1, 1), (1, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
