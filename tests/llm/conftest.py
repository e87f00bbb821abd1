import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "MIT License. mit license"), (5, "MIT License. mit license"), (5, "MIT License. mit license"), (None, "no id here, apache license text"),
    (6, "the general public license general public license"), (7, "x" * 5000), (8, "ab " * 20000), (9, "Été K it's 12 中文 <|endoftext|>"), (10, "a\nb\na\nb\na b c d e f g"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("label", T.StringType()), T.StructField("row", T.StringType())])
    return spark.createDataFrame([(*r, "x", None, "y") for r in EDGE], schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
