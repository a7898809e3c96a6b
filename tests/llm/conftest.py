import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, a very long text, and columns that clash with names used inside."""
    rng = random.Random(1)
    long = "\n".join(" ".join(rng.choice(("ab", "cd", "ef", "gh", "ij")) for _ in range(50)) for _ in range(400))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "a", "x"), (1, "one two three four five six seven eight nine ten eleven", "a", "x"),
        (2, None, None, None), (3, "", "b", ""), (None, "no id but words enough to count as ten of them here", None, "y"), (None, None, None, None),
        (4, " \t\n ", "b", "z"), (5, long, "c", "w"), (6, "ONE two three four five six seven eight nine ten eleven", "a", "x"), (7, "short", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
