import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a very long one, ties, repeated rows, a null source, and columns with clashing names."""
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3), (4, base, "en", "b", 9), (5, base, "en", None, 9), (5, base, "en", None, 9), (6, base + " tail", "de", "a", 9), (7, words(rng, 40_000, 9000), "en", "c", 9), (8, "one two", "fr", "c", 7), (9, "One TWO", "fr", "c", 7), (10, "é ünïcödé \U0001f600 x", "fr", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' as id", "1 as key", "2 as side", "3 as size", "'y' as target", "'z' as score", "0 as `count`")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
