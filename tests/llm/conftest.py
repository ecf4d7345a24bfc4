import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (id, text) pairs, with columns whose names could clash."""
    def make(pairs):
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()),
            T.StructField("text_sha256", T.StringType()), T.StructField("content", T.LongType())])
        return spark.createDataFrame([(i, t, None, "x", None, 7) for i, t in pairs], schema)
    return make


def by_id(frame, key="doc_id"):
    return {row[key]: row.asDict() for row in frame.collect()}
