import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, x int"

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, "the quick brown fox jumps over the lazy dog and runs far away from here now"),
    (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "ünïcödé 日本語 👍 <|endoftext|> 's"), (None, "no id at all but some words that repeat"),
    (9, "word " * 9000), (10, "x" * 30000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, repeats, ties, long and empty texts, and columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "clash", 1) for i, t in TEXTS], WIDE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], WIDE)
