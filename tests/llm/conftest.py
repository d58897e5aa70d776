import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small frame of documents: null, empty, tied, repeated and long texts, and columns with clashing names."""

    def make(texts, ids=None):
        rows = [(i, t, "x", i) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, score string, n long").repartition(3)

    return make
