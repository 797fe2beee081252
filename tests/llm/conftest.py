import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of given (doc_id, text[, source]) rows, with a column whose name clashes with what operators make."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS score", "'y' AS size", "'z' AS bucket")

    return make
