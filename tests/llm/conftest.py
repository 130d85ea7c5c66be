import pytest

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
#: Nulls, empty and very long texts, ties, repeated rows.
TEXTS = [(1, "One two three four five six seven."), (2, None), (3, ""), (None, "no id here at all, none"), (4, LONG), (5, "one TWO three four five six seven."), (1, "One two three four five six seven."), (6, "a\n\na\n b\t\x0b"), (7, None)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns of names that the operators use themselves."""
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), k, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, id int")
