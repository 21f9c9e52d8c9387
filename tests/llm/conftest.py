import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, component_id string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1, "x", "y"),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", "a", 1, "x", "y"),
        (3, None, "en", "a", None, None, None),
        (4, "", None, None, 0, "", ""),
        (5, long, "en", "b", len(long), "x", "y"),
        (6, long + " end", "de", "b", None, "x", "y"),
        (7, "Los de la casa", "es", None, 1, None, "y"),
        (7, "Los de la casa", "es", None, 1, None, "y"),
        (None, "Los de la casa", None, None, 1, None, None),
        (None, None, None, None, None, None, None),
        (8, "1234 !!! ...", "en", "a", 12, "x", "y"),
        (9, "one", "en", "a", 3, "x", "y"),
        (10, "ONE", "en", "a", 3, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
