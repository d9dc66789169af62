import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    words = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"line number {i} of a long text that goes on and on" for i in range(3000))
    rows = [
        (1, words, "en", "a", 10),
        (2, words + " tail", "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n", "en", "b", 3),
        (6, long, "de", None, 1),
        (7, "one two", "fr", "c", 7),
        (8, "ONE  two", "fr", "c", 8),
        (9, "é ÿ \U0001f600 日本 x", None, "a", 9),
        (None, words, "en", "a", 1),
        (7, "one two", "fr", "c", 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "key", "n", "size", "hash", "mark", "keep", "score", "component", "bucket", "hub", "part", "tail", "weight", "target", "group", "length", "start", "line", "pos", "toxic", "rank", "block"]
    return odd_docs.withColumns({n: F.lit(f"own {n}") for n in names})
