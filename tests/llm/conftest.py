import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (id, text) pairs, with columns whose names clash with operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", n_tokens int, score string")

    return make
