import pytest

SCHEMA = "doc_id long, text string, lang string, source string, digest string, fp long, name string, kept boolean, ids string, score double, component_id long, size int, label string"


def frame(spark, rows):
    """documents with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", "d", 1, "n", True, "i", 0.5, 7, 3, "l") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, rows of one id."""
    long = "word " * 40_000 + "ende"
    base = "The quick brown fox jumps over the lazy dog while seven old men watch from the garden wall and say nothing at all about it"
    rows = [(1, base, "en"), (2, base.upper(), "en"), (2, base.upper(), "en"), (3, None, None), (None, "", "en"), (None, base, None), (4, "", None), (5, long, "de"), (6, long + "!", "de"), (7, "É été à la mer", "fr"), (7, "É ÉTÉ à la mer", "fr"), (8, " \t\n\x0b\x0c\r ", "fr"), (9, "🙂 ▁ <s> 日本", "ja"), (9, "other text under the same id", "en")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
