"""Spatial overlay of boxes without a nested-loop join, and what is summed over the pieces."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(spark, side: int, cell: int) -> DataFrame:
    """side x side square cells from the origin: unit_id grid_{col}_{row}, bounds and area."""
    cells = spark.range(side).withColumnRenamed("id", "col").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))))
    x, y = F.col("col") * cell, F.col("row") * cell
    return cells.select(F.concat_ws("_", F.lit("grid"), "col", "row").alias("unit_id"), "col", "row", x.alias("ux0"), y.alias("uy0"), (x + cell).alias("ux1"), (y + cell).alias("uy1"), F.lit(float(cell * cell)).alias("unit_area"))


def _buckets(lo: str, hi: str, size: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))


def overlay_boxes(units: DataFrame, layer: DataFrame, size: int = 100) -> DataFrame:
    """Pieces of `layer` (x0, y0, x1, y1) in `units` (ux0, uy0, ux1, uy1) of positive area: both sides' columns and piece_area.

    Both sides are dealt to square buckets they touch and joined on equal buckets; a pair is kept only in the bucket that holds the
    lower left corner of its intersection, so it comes once without a distinct. Boxes that only touch give no piece.
    """
    left = units.withColumn("bx", _buckets("ux0", "ux1", size)).withColumn("by", _buckets("uy0", "uy1", size))
    right = layer.withColumn("bx", _buckets("x0", "x1", size)).withColumn("by", _buckets("y0", "y1", size))
    x, y = F.greatest("ux0", "x0"), F.greatest("uy0", "y0")
    w, h = F.least("ux1", "x1") - x, F.least("uy1", "y1") - y
    pairs = left.join(right, ["bx", "by"]).where((w > 0) & (h > 0) & (F.floor(x / size) == F.col("bx")) & (F.floor(y / size) == F.col("by")))
    return pairs.withColumn("piece_area", (w * h).cast("double")).drop("bx", "by")


def zero_filled(units: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on unit_id in which a unit without a row measured 0."""
    return units.join(table, "unit_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def share(num: Column, den: Column) -> Column:
    """NULL on an empty denominator."""
    return F.when(den > 0, num / den)


def area_where(condition: Column) -> Column:
    """Piece area summed where `condition` is true; an unknown condition is no match."""
    return F.sum(F.when(F.coalesce(condition, F.lit(False)), F.col("piece_area")).otherwise(0.0))


def union_area(boxes: pd.DataFrame) -> float:
    """Area of a union of boxes by coordinate compression."""
    xs, ys = np.unique(boxes[["x0", "x1"]].to_numpy()), np.unique(boxes[["y0", "y1"]].to_numpy())
    inside = np.zeros((len(xs), len(ys)), np.int32)
    a, b = np.searchsorted(xs, boxes["x0"]), np.searchsorted(xs, boxes["x1"])
    c, d = np.searchsorted(ys, boxes["y0"]), np.searchsorted(ys, boxes["y1"])
    for (i, j), s in (((a, c), 1), ((b, c), -1), ((a, d), -1), ((b, d), 1)):
        np.add.at(inside, (i, j), s)
    covered = inside.cumsum(0).cumsum(1)[:-1, :-1] > 0
    return float((np.diff(xs)[:, None] * np.diff(ys)[None, :] * covered).sum())


def dissolved_area(pieces: DataFrame) -> DataFrame:
    """(unit_id, dissolved_area): pieces clipped to their unit and united per unit, so a group is one unit's pieces."""
    clipped = pieces.select("unit_id", *[f(f"u{c}", c).cast("double").alias(c) for f, c in ((F.greatest, "x0"), (F.greatest, "y0"), (F.least, "x1"), (F.least, "y1"))])

    def unite(key: tuple, boxes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit_id": [key[0]], "dissolved_area": [union_area(boxes)]})

    return clipped.groupBy("unit_id").applyInPandas(unite, "unit_id string, dissolved_area double")


def largest(pieces: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Of each key, the columns of the row with the largest piece_area, the least `order` on ties; a winner's NULL stays NULL."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("piece_area"), -F.col(order))).alias("best")
    return pieces.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def transfer(pieces: DataFrame, target: str, numeric: Sequence[str], majority: Sequence[str], order: str) -> DataFrame:
    """Area-weighted means, each over the area where its column is known, and values of the largest piece."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("piece_area")).otherwise(0.0)
    means = [share(F.sum(F.col(c) * F.col("piece_area")), F.sum(known(c))).alias(c) for c in numeric]
    most = [F.max_by(F.col(c), F.struct(F.col("piece_area"), -F.col(order))).alias(c) for c in majority]
    return pieces.groupBy(target).agg(*means, *most, F.sum("piece_area").alias("overlap_area"))


def diluted(pieces: DataFrame, target: str, numeric: Sequence[str]) -> DataFrame:
    """Area-weighted means over the whole overlap: an unknown value dilutes the mean."""
    return pieces.groupBy(target).agg(*[share(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("piece_area")), F.sum("piece_area")).alias(c) for c in numeric])


def neighbours(cells: DataFrame) -> DataFrame:
    """Queen-contiguous pairs (unit_id, neighbour) of grid cells by equal col and row after eight shifts."""
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    moved = cells.select("unit_id", "col", "row", shifts.alias("s")).select("unit_id", (F.col("col") + F.col("s.i")).alias("col"), (F.col("row") + F.col("s.j")).alias("row"))
    return moved.join(cells.select("col", "row", F.col("unit_id").alias("neighbour")), ["col", "row"]).select("unit_id", "neighbour")


def points_in_boxes(points: DataFrame, units: DataFrame, size: int = 100) -> DataFrame:
    """Pairs of a point (px, py: twice its coordinates) and a unit it lies strictly inside; an equi-join on the point's bucket."""
    spread = units.withColumn("_bx", _buckets("ux0", "ux1", size)).withColumn("_by", _buckets("uy0", "uy1", size))
    placed = points.withColumn("_bx", F.floor(F.col("px") / (2 * size))).withColumn("_by", F.floor(F.col("py") / (2 * size)))
    inside = (F.col("px") > 2 * F.col("ux0")) & (F.col("px") < 2 * F.col("ux1")) & (F.col("py") > 2 * F.col("uy0")) & (F.col("py") < 2 * F.col("uy1"))
    return placed.join(spread, ["_bx", "_by"]).where(inside).drop("_bx", "_by")
