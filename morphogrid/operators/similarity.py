"""Similarity of label classes, for agreement that counts near misses in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Similarities of classes 1 to 17 as published (10.3390/rs12111769), each row from its own class on; the matrix is symmetric.
UPPER = (
    (1.00, 0.92, 0.83, 0.67, 0.58, 0.50, 0.58, 0.75, 0.42, 0.75, 0.33, 0.25, 0.08, 0.00, 0.25, 0.00, 0.00),
    (1.00, 0.92, 0.58, 0.67, 0.58, 0.67, 0.83, 0.42, 0.83, 0.42, 0.33, 0.25, 0.08, 0.33, 0.08, 0.08),
    (1.00, 0.50, 0.58, 0.67, 0.75, 0.92, 0.58, 0.92, 0.50, 0.42, 0.33, 0.17, 0.42, 0.17, 0.17),
    (1.00, 0.92, 0.83, 0.75, 0.50, 0.75, 0.58, 0.50, 0.58, 0.50, 0.33, 0.08, 0.33, 0.33),
    (1.00, 0.92, 0.83, 0.67, 0.83, 0.67, 0.58, 0.67, 0.50, 0.42, 0.17, 0.42, 0.42),
    (1.00, 0.92, 0.75, 0.92, 0.75, 0.67, 0.75, 0.67, 0.58, 0.25, 0.50, 0.50),
    (1.00, 0.67, 0.83, 0.67, 0.75, 0.67, 0.58, 0.42, 0.17, 0.42, 0.42),
    (1.00, 0.75, 0.92, 0.42, 0.50, 0.42, 0.25, 0.50, 0.33, 0.33),
    (1.00, 0.67, 0.58, 0.67, 0.75, 0.58, 0.33, 0.58, 0.58),
    (1.00, 0.42, 0.50, 0.42, 0.25, 0.50, 0.33, 0.33),
    (1.00, 0.92, 0.83, 0.67, 0.42, 0.67, 0.67),
    (1.00, 0.92, 0.75, 0.50, 0.75, 0.75),
    (1.00, 0.83, 0.58, 0.83, 0.83),
    (1.00, 0.75, 0.92, 0.92),
    (1.00, 0.75, 0.75),
    (1.00, 0.92),
    (1.00,),
)


def similarity() -> dict[tuple[int, int], float]:
    """Similarity of every ordered pair of classes."""
    half = {(i, i + j): value for i, row in enumerate(UPPER, 1) for j, value in enumerate(row)}
    return half | {(b, a): value for (a, b), value in half.items()}


def similarity_table(spark: SparkSession) -> DataFrame:
    """(reference, predicted, w), 289 rows."""
    return spark.createDataFrame([(a, b, w) for (a, b), w in similarity().items()], "reference int, predicted int, w double")
