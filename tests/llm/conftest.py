import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    def make(*rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        if extra:  # names that operators use inside
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(1) for c in ("key", "hits", "score", "_id", "_w", "line", "host", "bands", "y", "terms")})
        return df

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns."""
    return docs(
        (1, None, "a"), (2, "", "a"), (None, "one two three", None), (3, "word " * 30_000, "a"), (4, "x" * 100_000, "b"),
        (5, "same row", "a"), (5, "same row", "a"), (5, "same id, other text", "b"), (6, " \n\t ", None), extra=True)


@pytest.fixture
def none(docs, spark):
    return spark.createDataFrame([], DOCS)
