import pytest


@pytest.fixture
def docs(spark):
    """A function from texts to a documents table whose ids are the texts' places."""

    def make(texts, schema="doc_id bigint, text string"):
        return spark.createDataFrame(list(enumerate(texts)), schema)

    return make
