import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """rows -> documents, with a column whose name clashes with an operator's own."""

    def make(rows, extra=True):
        full = [(*r, *([None] * (4 - len(r))), "x") for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_words string")
        return frame if extra else frame.drop("n_words")

    return make
