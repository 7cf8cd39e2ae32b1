import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang, source]) rows with an extra column."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
