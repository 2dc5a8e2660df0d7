import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` tuples, with columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, True, 7, "x") for r in rows]
        schema = T.StructType([*DOCUMENTS.fields, T.StructField("kept", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("ids", T.StringType())])
        return spark.createDataFrame(full, schema)

    return make
