import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("size", T.StringType()),  # names that operators use themselves
    T.StructField("row", T.StringType()),
    T.StructField("bucket", T.StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with columns whose names clash with those of operators."""

    def build(rows):
        filled = [(i, t, s, "x", "y", "z") for i, t, s in (r if len(r) == 3 else (*r, "web") for r in rows)]
        return spark.createDataFrame(filled, DOC).repartition(3)

    return build
