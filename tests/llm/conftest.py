import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows, partitions=3):
        rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, class_id string").repartition(partitions)

    return make
