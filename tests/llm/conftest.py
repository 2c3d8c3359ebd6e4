import pytest
from llm.helpers import DOCUMENTS, odd_texts, rows_of


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, ids=None, parts=3):
        rows = rows_of(texts, ids)
        return spark.createDataFrame(rows, DOCUMENTS).repartition(parts) if rows else spark.createDataFrame([], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd():
    return odd_texts()
