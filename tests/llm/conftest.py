import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, lang, source) rows, with an extra column whose name clashes."""
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"
