"""Building heights: tiered gap filling, provenance, inheritance, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOREY = 3.0


def attribute_tier(height: Column, floors: Column, storey: float = STOREY) -> tuple[Column, Column]:
    """(height, source): a positive finite height, else floors of one and more times the storey height, else NULL."""
    known = height.isNotNull() & ~F.isnan(height) & (height > 0) & (height < float("inf"))
    counted = floors >= 1
    return F.when(known, height).when(counted, floors * storey), F.when(known, "height").when(counted, "floors")


def cascade(frame: DataFrame, tiers: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """Ordered tiers (name, value, floor): the first value above its floor wins; none leaves height NULL, source 'unresolved'."""
    height, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, value, floor in reversed(tiers):
        good = F.coalesce(value > floor, F.lit(False))
        height, source = F.when(good, value).otherwise(height), F.when(good, F.lit(name)).otherwise(source)
    return frame.withColumns({"filled_height": height, "height_source": F.coalesce(source, F.lit("unresolved"))})


def by_feature(pieces: DataFrame) -> DataFrame:
    """Parts of one feature in one unit count once: their area summed, their common height."""
    return pieces.groupBy("unit_id", "feature_id").agg(F.sum("piece_area").alias("area"), F.max("height").alias("height"))


def moments(pieces: DataFrame, floor: float = 0.1) -> DataFrame:
    """Geometric mean height of features (floored), and area-weighted geometric mean, mean and population deviation."""
    one = by_feature(pieces).where("height is not null")
    low = F.greatest(F.col("height"), F.lit(floor))
    w = F.sum("area")
    mean = F.sum(F.col("area") * F.col("height")) / w
    square = F.sum(F.col("area") * F.col("height") * F.col("height")) / w
    return one.groupBy("unit_id").agg(
        F.round(F.exp(F.avg(F.ln(low))), 6).alias("height_of_roughness_elements_m"), F.round(F.exp(F.sum(F.col("area") * F.ln(low)) / w), 6).alias("h_geometric_area_weighted"),
        F.round(mean, 6).alias("h_mean_area_weighted"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 5).alias("h_std"),
    )


def provenance(pieces: DataFrame, sources: Sequence[str], own: Sequence[str] = ("height", "floors")) -> DataFrame:
    """Area share of each configured height source in a unit, and of those that are the buildings' `own` attributes
    (height_completeness); columns come from the configuration, not the data."""
    total = F.sum("piece_area")
    share = lambda *s: F.round(F.sum(F.when(F.col("height_source").isin(*s), F.col("piece_area")).otherwise(0.0)) / total, 6)
    return pieces.groupBy("unit_id").agg(share(*[s for s in sources if s in own]).alias("height_completeness"), *[share(s).alias(f"height_frac_{s}") for s in sources])


def availability(frame: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Rows and flagged rows of each dataset, an unknown one as '(unknown)'."""
    return frame.groupBy(F.coalesce(key, F.lit("(unknown)")).alias("dataset")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])


def tagged(*columns: str) -> Column:
    """Some attribute says something: known, and not 'unknown' in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c).isNotNull() & (F.lower(c) != "unknown"))
    return out


def selected(subtype: Sequence[str], kind: Sequence[str]) -> Column:
    """subtype or class in the given vocabularies; NULL is no match."""
    return F.coalesce(F.col("subtype").isin(*subtype) if subtype else F.lit(False), F.lit(False)) | F.coalesce(F.col("class").isin(*kind) if kind else F.lit(False), F.lit(False))
