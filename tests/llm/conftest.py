import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, component_id string, size string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, and columns whose names clash with results."""
    rows = [
        (1, None, "en", "a", None, 1.0, "x", "y", "z"),
        (2, "", None, None, 0, None, None, None, None),
        (3, "one", "en", "a", 3, None, "x", None, None),
        (4, "The quick brown fox jumps over the lazy dog and runs away " * 3, "en", "b", 1, None, None, None, None),
        (4, "The quick brown fox jumps over the lazy dog and runs away " * 3, "en", "b", 1, None, None, None, None),
        (5, "The quick brown fox jumps over the lazy dog and runs away " * 3, "en", "a", 1, None, None, None, None),
        (None, "no id here at all", "fr", None, 1, None, None, None, None),
        (6, "wört ça 漢字 🙂 <|endoftext|> \t\n\x0b  1234 ½ " * 2000, "fr", "c", 1, None, None, None, None),
        (7, "x" * 300_000, None, "c", 1, None, None, None, None),
        (8, " \t\n ", "en", "c", 1, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
