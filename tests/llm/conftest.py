import pytest


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text[, source]) rows."""

    def make(rows, extra=""):
        rows = [(*r, "s0") if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string" + extra)

    return make
