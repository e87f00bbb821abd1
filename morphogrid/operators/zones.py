"""Zone classification: prototype boxes, weighted partial distance, ranking and rules, all as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("aspect_ratio", "building_sf", "impervious_sf", "pervious_sf", "height_m", "tree_sf", "water_sf", "mean_area_m2")
#: The published range of each property for the 17 classes, low,high; an open end is empty.
RANGES = """
1  2,      .40,.60 .40,.60 ,.10    25,   ,      ,    ,
2  .75,2   .40,.70 .30,.50 ,.20    10,25 ,      ,    ,
3  .75,1.5 .40,.70 .20,.50 ,.30    3,10  ,      ,    ,
4  .75,1.25 .20,.40 .30,.40 .30,.40 25,  ,      ,    ,
5  .3,.75  .20,.40 .30,.50 .20,.40 10,25 ,      ,    ,
6  .3,.75  .20,.40 .20,.50 .30,.60 3,10  ,      ,    ,
7  1,2     .60,.90 ,.20    ,.30    2,4   ,      ,    ,100
8  .1,.3   .30,.50 .40,.50 ,.20    3,10  ,      ,    500,
9  .1,.25  .10,.20 ,.20    .60,.80 3,10  ,      ,    ,
10 .2,.5   .20,.30 .20,.40 .40,.50 5,15  ,      ,    ,
11 1,      ,.10    ,.10    .90,    3,30  .5,    ,.1  ,
12 .25,.75 ,.10    ,.10    .90,    3,15  .1,.5  ,.1  ,
13 .25,1.0 ,.10    ,.10    .90,    ,2    ,.1    ,.1  ,
14 ,.1     ,.10    ,.10    .90,    ,1    ,.1    ,.1  ,
15 ,.1     ,.10    .90,    ,.10    ,.25  ,.1    ,.1  ,
16 ,.1     ,.10    ,.10    .90,    ,.25  ,.1    ,.1  ,
17 ,.1     ,.10    ,.10    .90,    ,      ,.1   .5,  ,
"""
#: Weights of the built classes; natural classes weigh all but the mean area alike.
BUILT_WEIGHTS = {"aspect_ratio": 3.0, "building_sf": 8.0, "height_m": 6.0}
NATURAL_WEIGHTS = {d: 1.0 for d in DIMENSIONS[:-1]}
BUILT, NATURAL = tuple(range(1, 11)), tuple(range(11, 18))
#: Natural classes that may win, the built gate, and the industrial share that class 10 must exceed.
REACHABLE = (11, 12, 14, 15, 17)
GATE, INDUSTRIAL = 0.10, 0.45


def prototypes() -> dict[int, dict[str, tuple[float | None, float | None]]]:
    out = {}
    for line in RANGES.strip().splitlines():
        code, *cells = line.split()
        out[int(code)] = {d: tuple(float(v) if v else None for v in c.split(",")) for d, c in zip(DIMENSIONS, cells, strict=True)}
    return out


def normalisation() -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the finite bounds of each dimension; no spread counts as 1."""
    out = {}
    for d in DIMENSIONS:
        bounds = [v for p in prototypes().values() for v in p[d] if v is not None]
        mean = sum(bounds) / len(bounds)
        out[d] = mean, math.sqrt(sum((b - mean) ** 2 for b in bounds) / len(bounds)) or 1.0
    return out


def gap(value: Column, low: float | None, high: float | None) -> Column:
    """Distance of a value to an interval, 0 inside."""
    terms = [F.lit(0.0)] + ([F.lit(low) - value] if low is not None else []) + ([value - F.lit(high)] if high is not None else [])
    return F.greatest(*terms) if len(terms) > 1 else F.lit(0.0)


def distance(code: int, columns: dict[str, Column], weights: dict[str, float]) -> Column:
    """Root of the weighted mean of squared normalised gaps over the known dimensions; NULL without one."""
    scale, box = normalisation(), prototypes()[code]
    num, den = F.lit(0.0), F.lit(0.0)
    for d, w in weights.items():
        if w and d in columns:
            known = columns[d].isNotNull()
            num = num + F.when(known, w * F.pow(gap(columns[d], *box[d]) / scale[d][1], F.lit(2.0))).otherwise(0.0)
            den = den + F.when(known, w).otherwise(0.0)
    return F.when(den > 0, F.sqrt(num / den))


def rounded(value: Column, decimals: int) -> Column:
    """Rounded in double arithmetic: Spark's round() goes through decimals, a third of the time of 17 distances a row."""
    return F.rint(value * 10.0**decimals) / 10.0**decimals


def with_distances(frame: DataFrame, columns: dict[str, str], decimals: int = 6) -> DataFrame:
    """`frame` with the 17 distances `lcz_d1` to `lcz_d17`, as `distance` gives them.

    A first projection has each squared gap once for each distinct interval of a dimension, and the weight of the known dimensions of
    either family; a second one only sums.
    """
    scale, boxes = normalisation(), prototypes()
    families = {c: BUILT_WEIGHTS if c in BUILT else NATURAL_WEIGHTS for c in (*BUILT, *NATURAL)}
    gaps: dict[tuple, str] = {}
    for code, weights in families.items():
        for d, w in weights.items():
            if w and d in columns:
                gaps.setdefault((d, *boxes[code][d]), f"gap {len(gaps)}")
    first = {}
    for (d, low, high), name in gaps.items():
        x = gap(F.col(columns[d]), low, high) / scale[d][1]
        first[name] = F.when(F.col(columns[d]).isNotNull(), x * x).otherwise(0.0)
    for name, weights in (("known built", BUILT_WEIGHTS), ("known natural", NATURAL_WEIGHTS)):
        first[name] = sum((F.when(F.col(columns[d]).isNotNull(), w).otherwise(0.0) for d, w in weights.items() if w and d in columns), F.lit(0.0))
    out = {}
    for code, weights in families.items():
        num = sum((F.lit(w) * F.col(gaps[d, *boxes[code][d]]) for d, w in weights.items() if w and d in columns), F.lit(0.0))
        den = F.col("known built" if code in BUILT else "known natural")
        out[f"lcz_d{code}"] = rounded(F.when(den > 0, F.sqrt(num / den)), decimals)
    return frame.withColumns(first).withColumns(out).drop(*first)


def classify(frame: DataFrame, columns: dict[str, str], industrial: str | None = None, decimals: int = 6) -> DataFrame:
    """`frame` with the 17 distances and its labels; one projection, no shuffle.

    built: building share at or over the gate (a NULL share raises). Candidates: classes 1 to 9, or the reachable natural ones.
    lcz_primary, lcz_secondary: the two nearest, lower codes first on ties; n_tied: candidates at the least distance (before rules);
    uniqueness: |d1 - d2| / (d1 + d2), 0 if both are 0, 1 without a runner-up, NULL without a label. Class 10 takes built units
    whose industrial share exceeds its threshold; the displaced label becomes the secondary, distance and uniqueness NULL.
    """
    value = {d: F.col(c) for d, c in columns.items()}
    bsf = value["building_sf"]
    frame = frame.withColumn("is_built", F.when(bsf.isNull(), F.raise_error(F.lit("a unit has no building share")).cast("boolean")).otherwise(bsf >= GATE))
    frame = with_distances(frame, columns, decimals)
    offer = lambda codes: F.array(*[F.struct(F.col(f"lcz_d{c}").alias("d"), F.lit(c).alias("code")) for c in codes])
    ranked = F.array_sort(F.filter(F.when(F.col("is_built"), offer(BUILT[:-1])).otherwise(offer(REACHABLE)), lambda x: x["d"].isNotNull()))
    frame = frame.withColumn("ranked", ranked)
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    d1, d2 = first["d"], second["d"]
    fires = (F.col("is_built") & (F.coalesce(F.col(industrial), F.lit(0.0)) > INDUSTRIAL)) if industrial else F.lit(False)
    unique = F.when(d1.isNull(), None).when(d2.isNull(), 1.0).when(d1 + d2 == 0, 0.0).otherwise(F.abs(d1 - d2) / (d1 + d2))
    weights = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(d)) for d, c in columns.items()]), lambda x: x.isNotNull())
    return frame.select(
        *[c for c in frame.columns if c != "ranked"],
        F.size(F.filter("ranked", lambda x: x["d"] == d1)).alias("n_tied_classes"),
        F.when(fires, F.lit(10)).otherwise(first["code"]).alias("lcz_primary"), F.when(fires, first["code"]).otherwise(second["code"]).alias("lcz_secondary"),
        F.when(~fires, d1).alias("min_distance"), F.when(~fires, F.round(unique, decimals)).alias("uniqueness"),
        F.when(fires, "industrial").when(F.col("is_built"), "built").otherwise("natural").alias("label_route"), F.concat_ws(",", weights).alias("missing_parameters"),
    )


def without_short(frame: DataFrame, height: Column, minimum: float | None) -> DataFrame:
    """`frame` without the distance to class 1 where the height is known to be under `minimum`; an unknown height drops nothing."""
    return frame if minimum is None else frame.withColumn("lcz_d1", F.when(~F.coalesce(height < minimum, F.lit(False)), F.col("lcz_d1")))


def height_dependent_weight(dimensions: Sequence[str] = ("aspect_ratio", "height_m")) -> list[tuple[str, float, float]]:
    """(family, weight, total weight): the weight of the dimensions that are made from the heights of buildings."""
    families = (("built", BUILT_WEIGHTS), ("natural", NATURAL_WEIGHTS))
    return [(name, sum(w for d, w in weights.items() if d in dimensions), sum(weights.values())) for name, weights in families]


def ordered_rules(label: Column, rules: Sequence[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """The label after ordered rules (name, condition, code), the last that fires winning; and the winner's name."""
    winner = F.lit(None).cast("string")
    for name, condition, code in rules:
        hit = F.coalesce(condition, F.lit(False))
        label, winner = F.when(hit, F.lit(code)).otherwise(label), F.when(hit, F.lit(name)).otherwise(winner)
    return label, winner


def overlapping_classes(spark, without: str | None = None) -> DataFrame:
    """Pairs of built classes whose boxes overlap strictly in every weighted dimension, so that no distance tells them apart."""
    inf = math.inf
    rows = [(c, d, p[d][0] if p[d][0] is not None else -inf, p[d][1] if p[d][1] is not None else inf) for c, p in prototypes().items() if c in BUILT[:-1] for d in BUILT_WEIGHTS if d != without]
    boxes = spark.createDataFrame(rows, "code int, dimension string, lo double, hi double")
    other = boxes.select(F.col("code").alias("other"), "dimension", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = boxes.join(other, "dimension").where("code < other").groupBy("code", "other").agg(F.expr("bool_and(lo < hi2 and lo2 < hi)").alias("same"))
    return pairs.where("same").select("code", "other")


def modal_filter(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One pass of the most frequent neighbouring label, read from a snapshot; the lower code wins ties, protected units stay."""
    votes = edges.join(labels.select(F.col("unit_id").alias("neighbour"), F.col("label").alias("vote")), "neighbour").where("vote is not null").groupBy("unit_id", "vote").count()
    modal = votes.groupBy("unit_id").agg(F.max_by("vote", F.struct(F.col("count"), -F.col("vote"))).alias("modal"))
    return labels.join(modal, "unit_id", "left").withColumn("smoothed", F.when(F.col("protected") | F.col("label").isNull(), F.col("label")).otherwise(F.coalesce("modal", "label"))).drop("modal")
