import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
COPY = " ".join(f"copied{i}" for i in range(40))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, LONG, "en", "b", len(LONG)),
        (5, COPY, "en", "b", len(COPY)),
        (6, COPY, "en", "b", len(COPY)),
        (6, COPY, "en", "b", len(COPY)),
        (7, COPY.upper() + " END", "en", "c", None),
        (None, COPY, "en", "c", None),
        (8, "é Ünïcode ß 漢字   x", "de", "c", 20),
        (9, "one", None, None, None),
        (10, "a b c d", "fr", "c", 7),
        (11, "!!! ,,, ...", "fr", "c", 11),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def texts(odd):
    return {(r["doc_id"], r["text"]) for r in odd.collect()}


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = "id key text_crc32 size shard slot spans items matches score class u v n p row label digest overlap secrets licenses"
    return odd.withColumns({n: F.lit(n) for n in names.split()})
