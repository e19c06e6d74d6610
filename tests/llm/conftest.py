import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
