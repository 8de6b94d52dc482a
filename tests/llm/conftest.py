import pytest


@pytest.fixture()
def frame(spark):
    """Makes a documents-like table of (doc_id, text) pairs, in any order, with an extra column of a clashing name."""

    def make(rows, more="secrets string"):
        return spark.createDataFrame([(i, t, None, None, "x") for i, t in rows], f"doc_id long, text string, lang string, source string, {more}")

    return make
