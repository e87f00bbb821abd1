"""Diagnostics of heights and labels: provenance entries, dispersion, implausible heights, labels that differ between two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pointer of a provenance entry about a height; an entry about the whole feature has none.
HEIGHT_PROPERTY = "/properties/height"


def provenance_entry(sources: Column, wanted: str = "") -> Column:
    """The first entry (property, dataset, confidence) of `sources` about `wanted`; a NULL property counts as an empty one."""
    return F.get(F.filter(sources, lambda s: F.coalesce(s["property"], F.lit("")) == wanted), F.lit(0))


def height_attribution(sources: Column) -> tuple[Column, Column]:
    """(dataset, confidence) of a height: of its own entry; without one the dataset of the footprint, and no confidence."""
    own = provenance_entry(sources, HEIGHT_PROPERTY)
    return F.coalesce(own["dataset"], provenance_entry(sources)["dataset"]), own["confidence"].cast("double")


def _median(column: Column) -> Column:
    return F.round(F.percentile(column, F.lit(0.5)), 5)


def dispersion(units: DataFrame, sources: Sequence[str], least_share: float = 0.05, least_count: int = 3) -> DataFrame:
    """Of each dominant height source: units, median deviation, median variation and share of units with a deviation under 0.01.

    `units` has height_frac_{source}, h_std, h_mean_area_weighted, building_surface_fraction and building_count. A unit belongs to the
    source with the largest share of its building area, the first of equal ones; units of less than `least_share` or `least_count`
    buildings, without a deviation or without any share are left out. A mean of 0 and less gives no variation.
    """
    shares = [F.col(f"height_frac_{s}") for s in sources]
    usable = units.where((F.col("building_surface_fraction") >= least_share) & (F.col("building_count") >= least_count) & F.col("h_std").isNotNull() & F.coalesce(*shares).isNotNull())
    largest = F.array_max(F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).alias("share"), F.lit(-i).alias("place"), F.lit(s).alias("source")) for i, (s, c) in enumerate(zip(sources, shares, strict=True))]))
    variation = F.when(F.col("h_mean_area_weighted") > 0, F.col("h_std") / F.col("h_mean_area_weighted"))
    return usable.groupBy(largest["source"].alias("height_source")).agg(
        F.count("*").alias("n_units"), _median(F.col("h_std")).alias("median_std"), _median(variation).alias("median_cv"), F.round(F.avg(F.when(F.col("h_std") < 0.01, 1.0).otherwise(0.0)), 6).alias("share_constant")
    )


def dispersion_by_source(buildings: DataFrame, least_count: int = 3) -> DataFrame:
    """Spread of the heights that one source gave inside a unit, by the sample deviation; `buildings`: unit_id, height_source, height."""
    each = buildings.where("height is not null").groupBy("height_source", "unit_id").agg(F.count("*").alias("n"), F.avg("height").alias("mean"), F.stddev_samp("height").alias("std")).where(F.col("n") >= least_count)
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))
    return each.groupBy("height_source").agg(
        F.count("*").alias("n_units"), F.sum("n").alias("n_buildings"), _median(cv).alias("median_cv"), F.round(F.avg(cv), 5).alias("mean_cv"), _median(F.col("std")).alias("median_std"),
        F.round(F.avg(F.when(F.col("std") < 1e-6, 1.0).otherwise(0.0)), 6).alias("share_constant"),
    )


def implausible(buildings: DataFrame) -> DataFrame:
    """Of each source: known heights, their shares under 2 and 3 metres, and the median; sources without a height are left out."""
    under = lambda v: F.round(F.avg(F.when(F.col("height") < v, 1.0).otherwise(0.0)), 6)
    return buildings.where("height is not null").groupBy("height_source").agg(F.count("*").alias("n"), under(2.0).alias("share_below_2m"), under(3.0).alias("share_below_3m"), _median(F.col("height")).alias("median_m"))


def flips(one: DataFrame, other: DataFrame) -> DataFrame:
    """Units (unit_id, before, after) labelled in either run (unit_id, label), with whether the label `moved`; a label that only one run
    gave has moved."""
    both = one.select("unit_id", F.col("label").alias("before")).join(other.select("unit_id", F.col("label").alias("after")), "unit_id", "full")
    return both.where("before is not null or after is not null").withColumn("moved", ~F.col("before").eqNullSafe(F.col("after")))


def flip_summary(flipped: DataFrame) -> DataFrame:
    """One row: units, moved units, their share (0 of nothing), and whether none moved."""
    n, moved = F.count("*"), F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0))
    return flipped.agg(n.alias("n_units"), moved.alias("n_moved"), F.round(F.when(n > 0, moved / n).otherwise(0.0), 6).alias("moved_fraction"), (moved == 0).alias("same"))


def transitions(flipped: DataFrame) -> DataFrame:
    """Moved units of each pair of labels; pairs with an unknown end are left out."""
    return flipped.where("moved and before is not null and after is not null").groupBy("before", "after").agg(F.count("*").alias("n"))
