"""Shared by the tests of the training-data operators (the ``spark`` fixture is the whole suite's)."""

import pytest

WORDS = "[^\\x20\\x09-\\x0D]+"


@pytest.fixture
def docs(spark):
    """Factory: texts (or (id, text) pairs) -> a documents table with columns whose names clash with ours."""
    def make(rows):
        data = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        data = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), 1, "x") for i, t in data]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size int, key string")
    return make
