import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows -> documents with two columns more, whose names clash with outputs."""

    def make(rows):
        shape = "doc_id long, text string, source string, n_tokens string, kept string, score string"
        return spark.createDataFrame([(i, t, "s", "x", "y", "z") for i, t in rows], shape)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, ties, repeated rows, a null identifier, a long text, odd characters."""
    long = "word " * 30_000
    return [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long), (7, "日本語 ñandú 😀 <|endoftext|> a\x00b\x01c"), (None, "a b c"), (9, "x" * 5000)]
