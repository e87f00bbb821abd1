"""Registers the queries of diagnostics, rules and places beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as dg
from ..operators import heights as ht
from ..operators import overlay as ov
from ..operators import places as pl
from ..operators import zones as zn
from ..sources import city
from . import catalogue as cat
from .catalogue import B, C, FILLED_SQL, LB, query

# ---------------------------------------------------------------- heights
ENTRY = {"none": [], "footprint": [("''", "'survey'", "NULL")], "both": [("NULL", "'footprints'", "NULL"), (f"'{dg.HEIGHT_PROPERTY}'", "'lidar'", "0.5")], "height": [(f"'{dg.HEIGHT_PROPERTY}'", "NULL", "0.25"), ("''", "'survey'", "NULL")]}


def _sources_text(struct: str, listed: str) -> str:
    """A nested provenance column in either dialect, by the part's number; every fifth part has none."""
    entry = lambda e: struct.format(*(f"CAST({v} AS {t})" for v, t in zip(e, ("VARCHAR(40)", "VARCHAR(40)", "DOUBLE"), strict=True)))
    arms = " ".join(f"WHEN part_id % 5 = {i} THEN {listed.format(', '.join(map(entry, v)))}" for i, v in enumerate(ENTRY.values()) if v)
    return f"CASE {arms} END"


SPARK_SOURCES = _sources_text("named_struct('property', {}, 'dataset', {}, 'confidence', {})", "array({})")
DUCK_SOURCES = _sources_text("{{'property': {}, 'dataset': {}, 'confidence': {}}}", "[{}]")


@query(f"""WITH s AS (SELECT part_id, {DUCK_SOURCES} AS sources FROM {B}),
e AS (SELECT part_id, list_filter(sources, lambda x: x.property = '{dg.HEIGHT_PROPERTY}')[1] AS own, list_filter(sources, lambda x: coalesce(x.property, '') = '')[1] AS whole FROM s)
SELECT part_id, whole.dataset AS footprint_dataset, coalesce(own.dataset, whole.dataset) AS height_dataset, own.confidence AS confidence FROM e""")
def height_attribution(spark, d):
    """Where each part's height and footprint come from, by the nested provenance entries."""
    parts = city.relation(spark, d, "buildings").select("part_id", F.expr(SPARK_SOURCES).alias("sources"))
    dataset, confidence = dg.height_attribution(F.col("sources"))
    return parts.select("part_id", dg.provenance_entry(F.col("sources"))["dataset"].alias("footprint_dataset"), dataset.alias("height_dataset"), confidence.alias("confidence"))


FILLED_MOMENTS = cat.MOMENTS_SQL.replace(cat.FEATURE_SQL, f"(SELECT unit_id, feature_id, sum(piece_area) AS area, max(filled_height) AS height FROM {cat.PF} GROUP BY 1, 2)")
_DOMINANT = "CASE " + " ".join(f"WHEN {' AND '.join([f'coalesce(height_frac_{s}, 0) >= coalesce(height_frac_{o}, 0)' for o in cat.SOURCES[i + 1 :]] or ['true'])} THEN '{s}'" for i, s in enumerate(cat.SOURCES)) + " END"


@query(f"""WITH p AS (SELECT b.building_surface_fraction, o.building_count, f.*, m.h_std, m.h_mean_area_weighted FROM ({cat.BSF_SQL}) b JOIN ({cat.ORACLES["object_metrics"]}) o USING (unit_id) JOIN ({cat.PROVENANCE_SQL}) f USING (unit_id) JOIN ({FILLED_MOMENTS}) m USING (unit_id)),
u AS (SELECT *, {_DOMINANT} AS height_source FROM p WHERE building_surface_fraction >= 0.05 AND building_count >= 3 AND h_std IS NOT NULL AND coalesce({", ".join(f"height_frac_{s}" for s in cat.SOURCES)}) IS NOT NULL)
SELECT height_source, count(*) AS n_units, round(median(h_std), 5) AS median_std, round(median(CASE WHEN h_mean_area_weighted > 0 THEN h_std / h_mean_area_weighted END), 5) AS median_cv, round(avg(CASE WHEN h_std < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS share_constant FROM u GROUP BY 1""")
def height_dispersion(spark, d):
    """Spread of filled heights inside units by the source that dominates them."""
    pieces = ov.overlay_boxes(cat._units(spark, d), cat._filled(spark, d)).withColumn("height", F.col("filled_height"))
    units = cat._bsf(spark, d).join(cat.QUERIES["object_metrics"](spark, d), "unit_id").join(ht.provenance(pieces, cat.SOURCES), "unit_id").join(ht.moments(pieces), "unit_id")
    return dg.dispersion(units, cat.SOURCES)


_PLACED = f"(SELECT 'grid_' || ((x0 + x1) // {2 * C}) || '_' || ((y0 + y1) // {2 * C}) AS unit_id, height_source, filled_height AS height FROM {FILLED_SQL} WHERE filled_height IS NOT NULL AND (x0 + x1) % {2 * C} <> 0 AND (y0 + y1) % {2 * C} <> 0)"


def _placed(spark, d):
    """Parts with a height in the cell that holds their centre strictly inside."""
    x, y = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    unit = F.concat_ws("_", F.lit("grid"), F.floor(x / (2 * C)), F.floor(y / (2 * C)))
    return cat._filled(spark, d).where((x % (2 * C) != 0) & (y % (2 * C) != 0)).select(unit.alias("unit_id"), "height_source", F.col("filled_height").alias("height"))


@query(f"""WITH e AS (SELECT height_source, unit_id, count(*) AS n, avg(height) AS m, stddev_samp(height) AS s FROM {_PLACED} GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT height_source, count(*) AS n_units, sum(n)::BIGINT AS n_buildings, round(median(CASE WHEN m > 0 THEN s / m END), 5) AS median_cv, round(avg(CASE WHEN m > 0 THEN s / m END), 5) AS mean_cv, round(median(s), 5) AS median_std, round(avg(CASE WHEN s < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS share_constant FROM e GROUP BY 1""")
def height_dispersion_by_source(spark, d):
    return dg.dispersion_by_source(_placed(spark, d))


@query(f"SELECT height_source, count(*) AS n, round(avg(CASE WHEN filled_height < 2 THEN 1.0 ELSE 0.0 END), 6) AS share_below_2m, round(avg(CASE WHEN filled_height < 3 THEN 1.0 ELSE 0.0 END), 6) AS share_below_3m, round(median(filled_height), 5)::DOUBLE AS median_m FROM {FILLED_SQL} WHERE filled_height IS NOT NULL GROUP BY 1")
def implausible_heights(spark, d):
    return dg.implausible(cat._filled(spark, d).select("height_source", F.col("filled_height").alias("height")))


# ---------------------------------------------------------------- rules
@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN h < 20 THEN NULL ELSE {cat._distance_sql(1, cat.LINE, zn.BUILT_WEIGHTS)} END AS lcz_d1 FROM ({cat.LINE_TEXT}) q")
def minimum_height_veto(spark, d):
    """The distance of the tallest class is dropped where the height is known to be less than a minimum."""
    line = spark.sql(cat.LINE_TEXT.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet"))
    return zn.without_short(zn.with_distances(line, cat.LINE), F.col("h"), 20.0).select("l_orderkey", "l_linenumber", "lcz_d1")


@query("SELECT family, weight, total_weight, round(weight / total_weight, 6) AS fraction FROM (VALUES ('built', 9.0::DOUBLE, 17.0::DOUBLE), ('natural', 2.0::DOUBLE, 7.0::DOUBLE)) t(family, weight, total_weight)")
def height_dependent_weight(spark, d):
    """How much of each family's weight moves with the heights of buildings; the two vectors are constants of the library."""
    return spark.createDataFrame(zn.height_dependent_weight(), "family string, weight double, total_weight double").withColumn("fraction", F.round(F.col("weight") / F.col("total_weight"), 6))


# ---------------------------------------------------------------- labels of two runs
_FLIPS = f"(SELECT before, after, before IS DISTINCT FROM after AS moved FROM (SELECT unit, predicted AS before FROM {LB} WHERE unit % 6 <> 0) FULL JOIN (SELECT unit, reference AS after FROM {LB} WHERE unit % 7 <> 0) USING (unit) WHERE before IS NOT NULL OR after IS NOT NULL)"


def _flips(spark, d):
    """Two runs over most of the same units: the predicted and the reference labels."""
    rows = city.relation(spark, d, "labels2")
    run = lambda c, k: rows.where(F.col("unit") % k != 0).select(F.col("unit").alias("unit_id"), F.col(c).alias("label"))
    return dg.flips(run("predicted", 6), run("reference", 7))


@query(f"SELECT count(*) AS n_units, coalesce(sum(moved::INT), 0)::BIGINT AS n_moved, round(CASE WHEN count(*) > 0 THEN sum(moved::INT) / count(*)::DOUBLE ELSE 0.0 END, 6) AS moved_fraction, coalesce(sum(moved::INT), 0) = 0 AS same FROM {_FLIPS}")
def label_flips(spark, d):
    return dg.flip_summary(_flips(spark, d))


@query(f"SELECT before, after, count(*) AS n FROM {_FLIPS} WHERE moved AND before IS NOT NULL AND after IS NOT NULL GROUP BY 1, 2")
def label_transitions(spark, d):
    return dg.transitions(_flips(spark, d))


# ---------------------------------------------------------------- places
PLACE_TEXT = """SELECT c_custkey AS ord, concat(CASE c_custkey % 6 WHEN 0 THEN 'São Paulo' WHEN 1 THEN 'East London' WHEN 2 THEN 'LONDON' WHEN 3 THEN 'Málaga d.C.' WHEN 4 THEN 'Lon-don' ELSE 'Düren' END, CASE WHEN c_custkey % 4 = 0 THEN concat(' ', cast(c_nationkey AS varchar(9))) ELSE '' END) AS name,
CASE WHEN c_nationkey % 3 = 0 THEN 'GBR' WHEN c_nationkey % 3 = 1 THEN 'CAN' ELSE 'CIV' END AS iso, CASE WHEN c_nationkey % 3 = 0 THEN 'United Kingdom' WHEN c_nationkey % 3 = 1 THEN 'Canada' ELSE 'Côte d’Ivoire' END AS country FROM {customer}"""
_PLACES = f"({PLACE_TEXT.replace('{customer}', 'customer')})"
_KEY = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"


def _places(spark, d):
    return spark.sql(PLACE_TEXT, customer=spark.read.parquet(f"{d}/customer.parquet"))


@query(f"SELECT ord, name, {_KEY.format('name')} AS name_key, {_KEY.format('country')} AS country_key FROM {_PLACES}")
def place_keys(spark, d):
    """Names without marks, case and punctuation."""
    return _places(spark, d).select("ord", "name", pl.name_key(F.col("name")).alias("name_key"), pl.name_key(F.col("country")).alias("country_key"))


@query(f"SELECT ord, name, iso, CASE WHEN {_KEY.format('name')} = 'london' THEN 0 ELSE 1 END AS tier FROM {_PLACES} WHERE contains({_KEY.format('name')}, 'london') AND (starts_with({_KEY.format('iso')}, 'cotedi') OR starts_with({_KEY.format('country')}, 'cotedi'))")
def place_find(spark, d):
    """Places of one country by name: equal keys before keys that contain the name."""
    return pl.find(_places(spark, d), "lóndon", "Cote d'I").select("ord", "name", "iso", "tier")
