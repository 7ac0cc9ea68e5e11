import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows to a documents table, with a clashing extra column."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None, "x") for i, t, s in rows], DOCS + ", row string")

    return make


@pytest.fixture
def vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("dim", T.StringType())])
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
