import pytest
from samples import odd_texts

SCHEMA = """doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, n_words int,
    band string, token_ids string, positions string, starts int, digest string"""


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text, source) with more columns, whose names operators use for their own."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t else None, 0.5, True, 3, "x", "y", "z", 1, "d") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    return docs(odd_texts())
