"""Registry of the relational queries and their SQL oracles, all over the synthetic city and the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators.similarity import similarity, similarity_table
from ..operators import graph as gr
from ..operators import heights as ht
from ..operators import overlay as ov
from ..operators import zones as zn
from ..session import ship_package
from ..sources import city

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = city.CELL
W = city.WIDTH_SQL

# ---------------------------------------------------------------- shared relations of the oracles
B, L, ST, PX, LB = (f"({city.oracle(n)})" for n in ("buildings", "land_use", "streets", "pixels", "labels2"))
U = f"""(SELECT 'grid_' || c || '_' || r AS unit_id, c AS col, r AS row, c * {C} AS ux0, r * {C} AS uy0, (c + 1) * {C} AS ux1, (r + 1) * {C} AS uy1, {C * C}.0::DOUBLE AS unit_area
FROM (SELECT unnest(range({W} // {C})) AS c), (SELECT unnest(range({W} // {C})) AS r))"""


def _pieces_sql(layer: str) -> str:
    return f"""(SELECT u.*, b.*, (least(ux1, x1) - greatest(ux0, x0))::DOUBLE * (least(uy1, y1) - greatest(uy0, y0)) AS piece_area
FROM {U} u JOIN {layer} b ON b.x0 < u.ux1 AND b.x1 > u.ux0 AND b.y0 < u.uy1 AND b.y1 > u.uy0)"""


PB, PL = _pieces_sql(B), _pieces_sql(L)


def query(oracle: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return register


def _units(spark, d):
    return ov.grid(spark, city.width(spark, d) // C, C)


def _building_pieces(spark, d):
    return ov.overlay_boxes(_units(spark, d), city.relation(spark, d, "buildings"))


def _land_pieces(spark, d):
    return ov.overlay_boxes(_units(spark, d), city.relation(spark, d, "land_use"))


def _bsf(spark, d):
    area = _building_pieces(spark, d).groupBy("unit_id").agg(F.sum("piece_area").alias("building_area"))
    return ov.zero_filled(_units(spark, d), area, ["building_area"]).select("unit_id", "building_area", (F.col("building_area") / F.col("unit_area")).alias("building_surface_fraction"))


BSF_SQL = f"SELECT u.unit_id, coalesce(a.building_area, 0.0) AS building_area, coalesce(a.building_area, 0.0) / u.unit_area AS building_surface_fraction FROM {U} u LEFT JOIN (SELECT unit_id, sum(piece_area) AS building_area FROM {PB} GROUP BY 1) a USING (unit_id)"
FEATURE_SQL = f"(SELECT unit_id, feature_id, sum(piece_area) AS area, max(height) AS height FROM {PB} GROUP BY 1, 2)"
MOMENTS_SQL = f"""SELECT unit_id, round(exp(avg(ln(greatest(height, 0.1)))), 6) AS height_of_roughness_elements_m, round(exp(sum(area * ln(greatest(height, 0.1))) / sum(area)), 6) AS h_geometric_area_weighted,
round(sum(area * height) / sum(area), 6) AS h_mean_area_weighted, round(sqrt(greatest(sum(area * height * height) / sum(area) - (sum(area * height) / sum(area)) * (sum(area * height) / sum(area)), 0.0)), 5) AS h_std
FROM {FEATURE_SQL} WHERE height IS NOT NULL GROUP BY unit_id"""


# ---------------------------------------------------------------- units, overlay, sums
@query(f"SELECT unit_id, ux0, uy0, ux1, uy1, unit_area FROM {U}")
def grid_units(spark, d):
    return _units(spark, d).select("unit_id", "ux0", "uy0", "ux1", "uy1", "unit_area")


@query(f"SELECT unit_id, part_id, feature_id, piece_area FROM {PB}")
def overlay_pieces(spark, d):
    return _building_pieces(spark, d).select("unit_id", "part_id", "feature_id", "piece_area")


@query(BSF_SQL)
def building_surface_fraction(spark, d):
    return _bsf(spark, d)


@query(MOMENTS_SQL)
def height_moments(spark, d):
    return ht.moments(_building_pieces(spark, d))


@query(f"""WITH f AS (SELECT feature_id, sum((x1 - x0) * (y1 - y0))::DOUBLE AS area, arg_min(x0 + x1, part_id) / 2.0 AS cx, arg_min(y0 + y1, part_id) / 2.0 AS cy FROM {B} GROUP BY 1)
SELECT u.unit_id, count(f.area) AS building_count, avg(f.area) AS mean_building_area_m2 FROM {U} u LEFT JOIN f ON f.cx > u.ux0 AND f.cx < u.ux1 AND f.cy > u.uy0 AND f.cy < u.uy1 GROUP BY 1""")
def object_metrics(spark, d):
    """Whole features by the centre of their first part, strictly inside: a centre on an edge is in no unit."""
    parts = city.relation(spark, d, "buildings")
    centre = F.min_by(F.struct(((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y")), "part_id").alias("c")
    whole = parts.groupBy("feature_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("area"), centre)
    inside = whole.where((F.col("c.x") % C != 0) & (F.col("c.y") % C != 0)).select("area", F.floor(F.col("c.x") / C).alias("col"), F.floor(F.col("c.y") / C).alias("row"))
    return _units(spark, d).join(inside, ["col", "row"], "left").groupBy("unit_id").agg(F.count("area").alias("building_count"), F.avg("area").alias("mean_building_area_m2"))


@query(f"SELECT u.unit_id, coalesce(a, 0.0) / u.unit_area AS covered_fraction FROM {U} u LEFT JOIN (SELECT unit_id, sum(piece_area) AS a FROM {PL} GROUP BY 1) p USING (unit_id)")
def covered_fraction_sum(spark, d):
    area = _land_pieces(spark, d).groupBy("unit_id").agg(F.sum("piece_area").alias("a"))
    return ov.zero_filled(_units(spark, d), area, ["a"]).select("unit_id", (F.col("a") / F.col("unit_area")).alias("covered_fraction"))


@query(f"""WITH m AS (SELECT DISTINCT mx, unnest(range(y0, y1)) AS my FROM (SELECT unnest(range(x0, x1)) AS mx, y0, y1 FROM {L})),
c AS (SELECT 'grid_' || (mx // {C}) || '_' || (my // {C}) AS unit_id, count(*)::DOUBLE AS a FROM m GROUP BY 1)
SELECT u.unit_id, coalesce(a, 0.0) / u.unit_area AS covered_fraction FROM {U} u LEFT JOIN c USING (unit_id)""")
def covered_fraction_dissolved(spark, d):
    return ov.zero_filled(_units(spark, d), ov.dissolved_area(_land_pieces(spark, d)), ["dissolved_area"]).select("unit_id", (F.col("dissolved_area") / F.col("unit_area")).alias("covered_fraction"))


@query(f"""WITH b AS (SELECT unit_id, sum(piece_area) AS total, sum(CASE WHEN subtype = 'industrial' OR class = 'industrial' THEN piece_area ELSE 0.0 END) AS ind FROM {PB} GROUP BY 1),
l AS (SELECT unit_id, sum(CASE WHEN class = 'industrial' THEN piece_area ELSE 0.0 END) AS ind FROM {PL} GROUP BY 1)
SELECT u.unit_id, CASE WHEN total > 0 THEN b.ind / total END AS industrial_fraction_of_building_area, coalesce(b.ind, 0.0) / unit_area AS industrial_fraction_buildings, coalesce(l.ind, 0.0) / unit_area AS industrial_fraction_land_use,
CASE WHEN coalesce(b.ind, 0) > 0 AND coalesce(l.ind, 0) > 0 THEN 'both' WHEN coalesce(b.ind, 0) > 0 THEN 'buildings' WHEN coalesce(l.ind, 0) > 0 THEN 'land_use' ELSE 'none' END AS industrial_evidence
FROM {U} u LEFT JOIN b USING (unit_id) LEFT JOIN l USING (unit_id)""")
def industrial_shares(spark, d):
    return _industrial(spark, d)


def _industrial(spark, d):
    b = _building_pieces(spark, d).groupBy("unit_id").agg(F.sum("piece_area").alias("total"), ov.area_where(ht.selected(["industrial"], ["industrial"])).alias("ib"))
    l = _land_pieces(spark, d).groupBy("unit_id").agg(ov.area_where(F.col("class") == "industrial").alias("il"))
    all_ = _units(spark, d).join(b, "unit_id", "left").join(l, "unit_id", "left")
    ib, il = F.coalesce("ib", F.lit(0.0)), F.coalesce("il", F.lit(0.0))
    return all_.select("unit_id", ov.share(F.col("ib"), F.col("total")).alias("industrial_fraction_of_building_area"), (ib / F.col("unit_area")).alias("industrial_fraction_buildings"), (il / F.col("unit_area")).alias("industrial_fraction_land_use"),
                       F.when((ib > 0) & (il > 0), "both").when(ib > 0, "buildings").when(il > 0, "land_use").otherwise("none").alias("industrial_evidence"))


#: Semantic groups of buildings: subtypes and classes, overlapping on purpose.
GROUPS = {"lightweight": ((), ("shed",)), "large_lowrise": (("commercial",), ("warehouse",)), "heavy_industry": (("industrial",), ("industrial",)), "residential": (("residential",), ()), "commercial": (("commercial",), ())}


def _in_sql(subtypes, classes):
    test = lambda c, v: f"coalesce({c} IN ({', '.join(repr(x) for x in v)}), false)" if v else "false"
    return f"({test('subtype', subtypes)} OR {test('class', classes)})"


@query(f"""WITH p AS (SELECT unit_id, sum(piece_area) AS total, {", ".join(f"sum(CASE WHEN {_in_sql(*v)} THEN piece_area ELSE 0.0 END) AS {g}" for g, v in GROUPS.items())},
sum(CASE WHEN (subtype IS NOT NULL AND lower(subtype) <> 'unknown') OR (class IS NOT NULL AND lower(class) <> 'unknown') THEN piece_area ELSE 0.0 END) AS tagged FROM {PB} GROUP BY 1)
SELECT u.unit_id, {", ".join(f"CASE WHEN total > 0 THEN {g} / total END AS sem_{g}_buildings_of_building_area" for g in GROUPS)}, CASE WHEN total > 0 THEN tagged / total END AS building_tag_coverage FROM {U} u LEFT JOIN p USING (unit_id)""")
def semantic_shares(spark, d):
    p = _building_pieces(spark, d).groupBy("unit_id").agg(F.sum("piece_area").alias("total"), *[ov.area_where(ht.selected(*v)).alias(g) for g, v in GROUPS.items()], ov.area_where(ht.tagged("subtype", "class")).alias("tagged"))
    return _units(spark, d).join(p, "unit_id", "left").select("unit_id", *[ov.share(F.col(g), F.col("total")).alias(f"sem_{g}_buildings_of_building_area") for g in GROUPS], ov.share(F.col("tagged"), F.col("total")).alias("building_tag_coverage"))


@query(f"""WITH p AS (SELECT s.*, u.unit_id, CASE WHEN axis = 'h' THEN least(hi, ux1) - greatest(lo, ux0) ELSE least(hi, uy1) - greatest(lo, uy0) END AS len FROM {U} u JOIN {ST} s
ON CASE WHEN axis = 'h' THEN fixed >= uy0 AND fixed <= uy1 AND lo < ux1 AND hi > ux0 ELSE fixed >= ux0 AND fixed <= ux1 AND lo < uy1 AND hi > uy0 END)
SELECT unit_id, sum(len)::DOUBLE AS street_length, round(sum(width * len) / nullif(sum(CASE WHEN width IS NOT NULL THEN len END), 0), 6) AS street_width_m, round(sum(openness * len) / nullif(sum(CASE WHEN openness IS NOT NULL THEN len END), 0), 6) AS street_openness FROM p GROUP BY 1""")
def street_weighted_mean(spark, d):
    """Street lengths clipped to cells; a street on a shared edge counts in both."""
    s = city.relation(spark, d, "streets")
    along = F.explode(F.sequence(F.floor(F.col("lo") / C), F.floor((F.col("hi") - 1) / C)))
    across = F.explode(F.when(F.col("fixed") % C == 0, F.array(F.floor(F.col("fixed") / C) - 1, F.floor(F.col("fixed") / C))).otherwise(F.array(F.floor(F.col("fixed") / C))))
    cut = s.withColumn("i", along).withColumn("j", across)
    cut = cut.withColumn("len", F.least("hi", (F.col("i") + 1) * C) - F.greatest("lo", F.col("i") * C)).withColumn("col", F.when(F.col("axis") == "h", F.col("i")).otherwise(F.col("j"))).withColumn("row", F.when(F.col("axis") == "h", F.col("j")).otherwise(F.col("i")))
    mean = lambda c: F.round(ov.share(F.sum(F.col(c) * F.col("len")), F.sum(F.when(F.col(c).isNotNull(), F.col("len")).otherwise(0))), 6)
    return _units(spark, d).join(cut, ["col", "row"]).groupBy("unit_id").agg(F.sum("len").cast("double").alias("street_length"), mean("width").alias("street_width_m"), mean("openness").alias("street_openness"))


# ---------------------------------------------------------------- raster
CLASS_SQL = "CASE WHEN code = 0 THEN NULL WHEN code IN (10, 20) THEN 'tree' WHEN code IN (30, 40) THEN 'pervious' WHEN code = 50 THEN 'impervious' WHEN code = 60 THEN 'water' END"
LAND = ("tree", "pervious", "impervious", "water")
CELL_OF_PIXEL = f"'grid_' || (px * 10 // {C}) || '_' || (py * 10 // {C})"
LC_SQL = f"""SELECT u.unit_id, {", ".join(f"CASE WHEN n > 0 THEN n_{c} / n::DOUBLE END AS frac_{c}" for c in LAND)} FROM {U} u LEFT JOIN
(SELECT unit_id, count(k) AS n, {", ".join(f"count(*) FILTER (k = '{c}') AS n_{c}" for c in LAND)} FROM (SELECT {CELL_OF_PIXEL} AS unit_id, {CLASS_SQL} AS k FROM {PX}) GROUP BY 1) f USING (unit_id)"""


def _land_cover(spark, d):
    code = F.col("code")
    kind = F.when(code == 0, None).when(code.isin(10, 20), "tree").when(code.isin(30, 40), "pervious").when(code == 50, "impervious").when(code == 60, "water").otherwise(F.raise_error(F.lit("an unmapped land-cover code")))
    px = city.relation(spark, d, "pixels").select(F.floor(F.col("px") * 10 / C).alias("col"), F.floor(F.col("py") * 10 / C).alias("row"), kind.alias("k"))
    counts = px.groupBy("col", "row").agg(F.count("k").alias("n"), *[F.sum(F.when(F.col("k") == c, 1).otherwise(0)).alias(f"n_{c}") for c in LAND])
    return _units(spark, d).join(counts, ["col", "row"], "left").select("unit_id", *[ov.share(F.col(f"n_{c}"), F.col("n")).alias(f"frac_{c}") for c in LAND])


@query(LC_SQL)
def landcover_fractions(spark, d):
    return _land_cover(spark, d)


@query(f"""SELECT {CELL_OF_PIXEL} AS unit_id, sum(CASE WHEN code >= 30 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS canopy_tree, sum(CASE WHEN code >= 30 THEN 0 ELSE 1 END) / count(*)::DOUBLE AS canopy_non_tree FROM {PX} GROUP BY 1""")
def canopy_binned(spark, d):
    """One threshold, bins closed on the left; nodata is assigned to the low bin."""
    high = F.when(F.col("code") == 0, 0).when(F.col("code") >= 30, 1).otherwise(0)
    unit = F.concat_ws("_", F.lit("grid"), F.floor(F.col("px") * 10 / C), F.floor(F.col("py") * 10 / C))
    return city.relation(spark, d, "pixels").groupBy(unit.alias("unit_id")).agg((F.sum(high) / F.count("*")).alias("canopy_tree"), (F.sum(1 - high) / F.count("*")).alias("canopy_non_tree"))


SURFACE_SQL = f"""SELECT u.unit_id, l.frac_tree + l.frac_pervious AS pervious_surface_fraction, CASE WHEN l.frac_impervious IS NOT NULL THEN greatest(l.frac_impervious - b.building_surface_fraction, 0.0) END AS impervious_surface_fraction,
l.frac_impervious < b.building_surface_fraction AS impervious_clipped, l.frac_tree AS tree_fraction, l.frac_water AS water_fraction FROM {U} u JOIN ({BSF_SQL}) b USING (unit_id) JOIN ({LC_SQL}) l USING (unit_id)"""


def _surface(spark, d):
    rest = F.col("frac_impervious") - F.col("building_surface_fraction")
    both = _bsf(spark, d).join(_land_cover(spark, d), "unit_id")
    return both.select("unit_id", (F.col("frac_tree") + F.col("frac_pervious")).alias("pervious_surface_fraction"), F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0))).alias("impervious_surface_fraction"), (F.col("frac_impervious") < F.col("building_surface_fraction")).alias("impervious_clipped"), F.col("frac_tree").alias("tree_fraction"), F.col("frac_water").alias("water_fraction"))


@query(SURFACE_SQL)
def surface_fractions(spark, d):
    return _surface(spark, d)


@query(f"""WITH c AS (SELECT {CELL_OF_PIXEL} AS unit_id, code, count(*) AS n FROM {PX} WHERE code > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, code) AS k, sum(n) OVER (PARTITION BY unit_id) AS total FROM c)
SELECT unit_id, code AS reference, n / total::DOUBLE AS majority_share FROM r WHERE k = 1""")
def reference_majority(spark, d):
    """The most frequent code of each cell, the lower on ties."""
    unit = F.concat_ws("_", F.lit("grid"), F.floor(F.col("px") * 10 / C), F.floor(F.col("py") * 10 / C))
    n = city.relation(spark, d, "pixels").where("code > 0").groupBy(unit.alias("unit_id"), F.col("code")).agg(F.count("*").alias("n"))
    return n.groupBy("unit_id").agg(F.max_by("code", F.struct(F.col("n"), -F.col("code"))).alias("reference"), (F.max("n") / F.sum("n")).alias("majority_share"))


# ---------------------------------------------------------------- heights
FILLED_SQL = f"""(SELECT *, CASE WHEN height > 0 THEN height WHEN num_floors >= 1 THEN num_floors * 3.0 WHEN part_id % 4 < 2 AND part_id % 50 > 2 THEN (part_id % 50)::DOUBLE END AS filled_height,
CASE WHEN height > 0 THEN 'height' WHEN num_floors >= 1 THEN 'floors' WHEN part_id % 4 < 2 AND part_id % 50 > 2 THEN 'areal' ELSE 'unresolved' END AS height_source FROM {B})"""
SOURCES = ("height", "floors", "areal", "unresolved")


def _filled(spark, d):
    areal = F.when(F.col("part_id") % 4 < 2, (F.col("part_id") % 50).cast("double"))
    tiers = [("height", F.col("height"), 0.0), ("floors", F.when(F.col("num_floors") >= 1, F.col("num_floors") * ht.STOREY), 0.0), ("areal", areal, 2.0)]
    return ht.cascade(city.relation(spark, d, "buildings"), tiers)


@query(f"SELECT part_id, filled_height::DOUBLE AS filled_height, height_source FROM {FILLED_SQL}")
def height_cascade(spark, d):
    return _filled(spark, d).select("part_id", "filled_height", "height_source")


PF = _pieces_sql(FILLED_SQL)
PROVENANCE_SQL = f"""SELECT u.unit_id, height_completeness, {", ".join(f"height_frac_{s}" for s in SOURCES)} FROM {U} u LEFT JOIN
(SELECT unit_id, round(sum(CASE WHEN height_source IN ('height', 'floors') THEN piece_area ELSE 0.0 END) / sum(piece_area), 6) AS height_completeness, {", ".join(f"round(sum(CASE WHEN height_source = '{s}' THEN piece_area ELSE 0.0 END) / sum(piece_area), 6) AS height_frac_{s}" for s in SOURCES)} FROM {PF} GROUP BY 1) p USING (unit_id)"""


@query(PROVENANCE_SQL)
def height_provenance_by_unit(spark, d):
    shares = ht.provenance(ov.overlay_boxes(_units(spark, d), _filled(spark, d)), SOURCES)
    return _units(spark, d).select("unit_id").join(shares, "unit_id", "left")


@query(f"SELECT coalesce(dataset, '(unknown)') AS dataset, count(*) AS n, sum(CASE WHEN height IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS with_height, sum(CASE WHEN num_floors >= 1 THEN 1 ELSE 0 END)::BIGINT AS with_floors FROM {B} GROUP BY 1")
def source_availability(spark, d):
    return ht.availability(city.relation(spark, d, "buildings"), "dataset", {"with_height": F.col("height").isNotNull(), "with_floors": F.col("num_floors") >= 1})


@query(f"""SELECT coalesce(dataset, '(unknown)') AS dataset, count(*) AS n, sum((x1 - x0) * (y1 - y0))::DOUBLE AS area, round(sum(CASE WHEN (subtype IS NOT NULL AND lower(subtype) <> 'unknown') OR (class IS NOT NULL AND lower(class) <> 'unknown') THEN (x1 - x0) * (y1 - y0) ELSE 0 END)::DOUBLE / sum((x1 - x0) * (y1 - y0)), 6) AS tagged_share,
array_to_string(list_sort(list(DISTINCT subtype) FILTER (subtype IS NOT NULL)), ',') AS vocabulary FROM {B} GROUP BY 1""")
def tag_availability(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    tag = F.sum(F.when(ht.tagged("subtype", "class"), area).otherwise(0)) / F.sum(area)
    return city.relation(spark, d, "buildings").groupBy(F.coalesce("dataset", F.lit("(unknown)")).alias("dataset")).agg(F.count("*").alias("n"), F.sum(area).cast("double").alias("area"), F.round(tag, 6).alias("tagged_share"), F.array_join(F.sort_array(F.collect_set("subtype")), ",").alias("vocabulary"))


@query(f"""WITH p AS (SELECT l.land_id, b.part_id, b.height, b.subtype, (least(l.x1, b.x1) - greatest(l.x0, b.x0)) * (least(l.y1, b.y1) - greatest(l.y0, b.y0)) AS a FROM {L} l JOIN {B} b ON b.x0 < l.x1 AND b.x1 > l.x0 AND b.y0 < l.y1 AND b.y1 > l.y0),
r AS (SELECT *, row_number() OVER (PARTITION BY land_id ORDER BY a DESC, part_id) AS k FROM p) SELECT land_id, height, subtype FROM r WHERE k = 1""")
def inherit_heights(spark, d):
    """Each parcel takes height and subtype of the building it overlaps most; a winner's unknown height stays unknown."""
    parcels = city.relation(spark, d, "land_use").select("land_id", F.col("x0").alias("ux0"), F.col("y0").alias("uy0"), F.col("x1").alias("ux1"), F.col("y1").alias("uy1"))
    return ov.largest(ov.overlay_boxes(parcels, city.relation(spark, d, "buildings")), "land_id", ["height", "subtype"], "part_id")


# ---------------------------------------------------------------- unit to unit
def _coarse(spark, d):
    """Cells of three by three, offset by half a cell, and the fine units' values on them."""
    side = city.width(spark, d) // (3 * C) + 2
    coarse = ov.grid(spark, side, 3 * C).select(F.col("unit_id").alias("zone_id"), *[(F.col(c) - C // 2).alias(c) for c in ("ux0", "uy0", "ux1", "uy1")])
    fine = _units(spark, d).select("unit_id", "col", "row", F.col("ux0").alias("x0"), F.col("uy0").alias("y0"), F.col("ux1").alias("x1"), F.col("uy1").alias("y1"))
    fine = fine.withColumn("ord", F.col("row") * 100000 + F.col("col")).withColumn("v", F.when((F.col("col") + F.col("row")) % 4 != 0, (F.col("col") * 3 + F.col("row")).cast("double"))).withColumn("k", F.concat(F.lit("k"), F.col("col") % 3))
    return ov.overlay_boxes(coarse, fine, 3 * C)


COARSE_SQL = f"""(SELECT z.zone_id, f.*, (least(zx1, ux1) - greatest(zx0, ux0))::DOUBLE * (least(zy1, uy1) - greatest(zy0, uy0)) AS piece_area FROM
(SELECT 'grid_' || c || '_' || r AS zone_id, c * {3 * C} - {C // 2} AS zx0, r * {3 * C} - {C // 2} AS zy0, (c + 1) * {3 * C} - {C // 2} AS zx1, (r + 1) * {3 * C} - {C // 2} AS zy1 FROM (SELECT unnest(range({W} // {3 * C} + 2)) AS c), (SELECT unnest(range({W} // {3 * C} + 2)) AS r)) z
JOIN (SELECT *, row * 100000 + col AS ord, CASE WHEN (col + row) % 4 <> 0 THEN (col * 3 + row)::DOUBLE END AS v, 'k' || (col % 3) AS k FROM {U}) f ON ux0 < zx1 AND ux1 > zx0 AND uy0 < zy1 AND uy1 > zy0)"""


@query(f"SELECT zone_id, round(sum(v * piece_area) / nullif(sum(CASE WHEN v IS NOT NULL THEN piece_area END), 0), 6) AS v, arg_max(k, (piece_area, -ord)) AS k, sum(piece_area) AS overlap_area FROM {COARSE_SQL} GROUP BY 1")
def unit_transfer_weighted(spark, d):
    return ov.transfer(_coarse(spark, d), "zone_id", ["v"], ["k"], "ord").withColumn("v", F.round("v", 6))


@query(f"SELECT zone_id, round(sum(coalesce(v, 0) * piece_area) / sum(piece_area), 6) AS v FROM {COARSE_SQL} GROUP BY 1")
def unit_aggregate_weighted(spark, d):
    return ov.diluted(_coarse(spark, d), "zone_id", ["v"]).withColumn("v", F.round("v", 6))


@query(f"WITH t AS (SELECT zone_id, k, sum(piece_area) AS a FROM {COARSE_SQL} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY a DESC, k) AS n FROM t) SELECT zone_id, k, a AS area FROM r WHERE n = 1")
def unit_aggregate_majority(spark, d):
    areas = _coarse(spark, d).groupBy("zone_id", "k").agg(F.sum("piece_area").alias("area"))
    order = Window.partitionBy("zone_id").orderBy(F.desc("area"), "k")
    return areas.withColumn("n", F.row_number().over(order)).where("n = 1").select("zone_id", "k", "area")


# ---------------------------------------------------------------- classification
COLUMNS = {"building_sf": "building_surface_fraction", "impervious_sf": "impervious_surface_fraction", "pervious_sf": "pervious_surface_fraction", "height_m": "height_of_roughness_elements_m", "tree_sf": "tree_fraction", "water_sf": "water_fraction"}
PARAM_SQL = f"(SELECT b.unit_id, b.building_surface_fraction, s.* EXCLUDE (unit_id), m.height_of_roughness_elements_m, i.industrial_fraction_of_building_area AS industrial FROM ({BSF_SQL}) b JOIN ({SURFACE_SQL}) s USING (unit_id) LEFT JOIN ({MOMENTS_SQL}) m USING (unit_id) JOIN ({ORACLES['industrial_shares']}) i USING (unit_id))"


def _distance_sql(code: int, columns: dict[str, str], weights: dict[str, float]) -> str:
    scale, box, num, den = zn.normalisation(), zn.prototypes()[code], [], []
    for d, w in weights.items():
        if d in columns:
            c, (lo, hi) = columns[d], box[d]
            gap = f"greatest(0.0{f', {lo!r} - {c}' if lo is not None else ''}{f', {c} - {hi!r}' if hi is not None else ''})"
            num.append(f"CASE WHEN {c} IS NOT NULL THEN {w!r} * pow({gap}::DOUBLE / {scale[d][1]!r}, 2) ELSE 0 END")
            den.append(f"CASE WHEN {c} IS NOT NULL THEN {w!r} ELSE 0 END")
    return f"round(sqrt(({' + '.join(num)})::DOUBLE / nullif(({' + '.join(den)})::DOUBLE, 0)), 6)"


def _classified_sql(params: str, columns: dict[str, str], industrial: str | None) -> str:
    dist = ", ".join(f"{_distance_sql(c, columns, zn.BUILT_WEIGHTS if c in zn.BUILT else zn.NATURAL_WEIGHTS)} AS lcz_d{c}" for c in (*zn.BUILT, *zn.NATURAL))
    offer = lambda codes: "[" + ", ".join(f"{{'d': lcz_d{c}, 'code': {c}}}" for c in codes) + "]"
    fires = f"(is_built AND coalesce({industrial}, 0.0) > {zn.INDUSTRIAL})" if industrial else "false"
    missing = ", ".join(f"CASE WHEN {c} IS NULL THEN '{d}' END" for d, c in columns.items())
    return f"""WITH p AS (SELECT *, {columns['building_sf']} >= {zn.GATE} AS is_built, {dist} FROM {params} q),
k AS (SELECT *, list_sort(list_filter(CASE WHEN is_built THEN {offer(zn.BUILT[:-1])} ELSE {offer(zn.REACHABLE)} END, lambda x: x.d IS NOT NULL)) AS ranked FROM p)
SELECT * EXCLUDE (ranked), len(list_filter(ranked, lambda x: x.d = ranked[1].d))::INTEGER AS n_tied_classes, CASE WHEN {fires} THEN 10 ELSE ranked[1].code END AS lcz_primary, CASE WHEN {fires} THEN ranked[1].code ELSE ranked[2].code END AS lcz_secondary,
CASE WHEN NOT {fires} THEN ranked[1].d END AS min_distance, CASE WHEN NOT {fires} THEN round(CASE WHEN ranked[1].d IS NULL THEN NULL WHEN ranked[2].d IS NULL THEN 1.0 WHEN ranked[1].d + ranked[2].d = 0 THEN 0.0 ELSE abs(ranked[1].d - ranked[2].d) / (ranked[1].d + ranked[2].d) END, 6)::DOUBLE END AS uniqueness,
CASE WHEN {fires} THEN 'industrial' WHEN is_built THEN 'built' ELSE 'natural' END AS label_route, concat_ws(',', {missing}) AS missing_parameters FROM k"""


def _parameters(spark, d):
    p = _bsf(spark, d).select("unit_id", "building_surface_fraction").join(_surface(spark, d), "unit_id").join(ht.moments(_building_pieces(spark, d)).select("unit_id", "height_of_roughness_elements_m"), "unit_id", "left")
    return p.join(_industrial(spark, d).select("unit_id", F.col("industrial_fraction_of_building_area").alias("industrial")), "unit_id")


MINIMAL = {"building_sf": "building_surface_fraction", "height_m": "height_of_roughness_elements_m"}
MINIMAL_SQL = f"(SELECT b.unit_id, b.building_surface_fraction, m.height_of_roughness_elements_m FROM ({BSF_SQL}) b LEFT JOIN ({MOMENTS_SQL}) m USING (unit_id))"
CLASSIFY_SQL = _classified_sql(PARAM_SQL, COLUMNS, "industrial")


@query(f"SELECT unit_id, building_surface_fraction, height_of_roughness_elements_m, CASE WHEN is_built THEN lcz_primary END AS lcz_primary, CASE WHEN is_built THEN uniqueness END AS uniqueness, (1 + (height_of_roughness_elements_m IS NOT NULL)::INTEGER) AS n_params_used FROM ({_classified_sql(MINIMAL_SQL, MINIMAL, None)})")
def label_cells(spark, d):
    """Every cell of the city with its building share, height and built label; natural cells have no label here."""
    params = _bsf(spark, d).select("unit_id", "building_surface_fraction").join(ht.moments(_building_pieces(spark, d)).select("unit_id", "height_of_roughness_elements_m"), "unit_id", "left")
    out = zn.classify(params, MINIMAL)
    return out.select("unit_id", *MINIMAL.values(), *[F.when(F.col("is_built"), F.col(c)).alias(c) for c in ("lcz_primary", "uniqueness")], (F.lit(1) + F.col("height_of_roughness_elements_m").isNotNull().cast("int")).alias("n_params_used"))


@query(CLASSIFY_SQL)
def classify_units(spark, d):
    return zn.classify(_parameters(spark, d), COLUMNS, "industrial")


LINE = {"building_sf": "a", "impervious_sf": "b", "pervious_sf": "c", "height_m": "h", "tree_sf": "t", "aspect_ratio": "r"}
LINE_TEXT = """SELECT l_orderkey, l_linenumber, l_discount * 6 AS a, l_tax * 10 AS b, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount * 9 END AS c, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS h,
l_tax * 8 AS t, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity / 20 END AS r FROM lineitem"""


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'{_distance_sql(c, LINE, zn.BUILT_WEIGHTS if c in zn.BUILT else zn.NATURAL_WEIGHTS)} AS lcz_d{c}' for c in (*zn.BUILT, *zn.NATURAL))} FROM ({LINE_TEXT}) q")
def prototype_distances(spark, d):
    line = spark.sql(LINE_TEXT.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet"))
    return zn.with_distances(line, LINE).select("l_orderkey", "l_linenumber", *[f"lcz_d{c}" for c in (*zn.BUILT, *zn.NATURAL)])


@query(f"""SELECT unit_id, CASE WHEN is_built AND height_of_roughness_elements_m < 8 THEN 7 WHEN is_built AND building_surface_fraction > 0.25 THEN 8 ELSE lcz_primary END AS label,
CASE WHEN is_built AND height_of_roughness_elements_m < 8 THEN 'lightweight' WHEN is_built AND building_surface_fraction > 0.25 THEN 'large_lowrise' END AS rule FROM ({CLASSIFY_SQL})""")
def semantic_rules(spark, d):
    """Ordered rules on classified units, the later overriding."""
    out = zn.classify(_parameters(spark, d), COLUMNS, "industrial")
    label, rule = zn.ordered_rules(F.col("lcz_primary"), [("large_lowrise", F.col("is_built") & (F.col("building_surface_fraction") > 0.25), 8), ("lightweight", F.col("is_built") & (F.col("height_of_roughness_elements_m") < 8), 7)])
    return out.select("unit_id", label.alias("label"), rule.alias("rule"))


MODAL_SQL = f"""WITH u AS (SELECT unit_id, col, row, ((col * 5 + row * 3) % 17 + 1)::INTEGER AS label, (col + row) % 11 = 0 AS protected FROM {U}),
v AS (SELECT a.unit_id, b.label AS vote, count(*) AS n FROM u a JOIN u b ON abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1 AND a.unit_id <> b.unit_id GROUP BY 1, 2),
m AS (SELECT unit_id, vote, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, vote) AS k FROM v)
SELECT u.unit_id, u.label, CASE WHEN protected THEN label ELSE coalesce(vote, label) END AS smoothed FROM u LEFT JOIN m ON u.unit_id = m.unit_id AND k = 1"""


@query(MODAL_SQL)
def modal_filter(spark, d):
    u = _units(spark, d).withColumn("label", ((F.col("col") * 5 + F.col("row") * 3) % 17 + 1).cast("int")).withColumn("protected", (F.col("col") + F.col("row")) % 11 == 0)
    return zn.modal_filter(u.select("unit_id", "label", "protected"), ov.neighbours(u)).select("unit_id", "label", "smoothed")


@query("SELECT * FROM (VALUES ('all', 3, 7), ('aspect_ratio', 3, 7), ('aspect_ratio', 3, 8), ('aspect_ratio', 6, 8), ('height_m', 2, 3), ('height_m', 2, 7), ('height_m', 3, 7), ('height_m', 5, 6), ('building_sf', 3, 7), ('building_sf', 8, 9)) AS t(without, code, other)")
def class_indistinguishable(spark, d):
    """Built classes that no distance tells apart, with all dimensions and without each."""
    parts = [zn.overlapping_classes(spark, None if x == "all" else x).select(F.lit(x).alias("without"), "code", "other") for x in ("all", *zn.BUILT_WEIGHTS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"SELECT lcz_primary, label_route, count(*) AS n, round(median(uniqueness), 6) AS median_uniqueness FROM ({CLASSIFY_SQL}) GROUP BY 1, 2")
def classification_summary(spark, d):
    return zn.classify(_parameters(spark, d), COLUMNS, "industrial").groupBy("lcz_primary", "label_route").agg(F.count("*").alias("n"), F.round(F.percentile("uniqueness", F.lit(0.5)), 6).alias("median_uniqueness"))


# ---------------------------------------------------------------- output
@query("SELECT (unnest(range(0, len(b))))::INTEGER AS place, unnest(b) AS value FROM (SELECT list_distinct(list_transform(quantile_cont(o_totalprice, [i / 7.0 for i in range(0, 8)]), lambda x: round(x, 6))) AS b0, list_sort(b0) AS b FROM orders)")
def quantile_breaks(spark, d):
    return ag.breaks(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 7).withColumnRenamed("pos", "place")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN l_extendedprice ELSE round_even(l_extendedprice * pow(10.0, 2 - floor(log10(abs(l_extendedprice)))), 0) / pow(10.0, 2 - floor(log10(abs(l_extendedprice)))) END AS price, greatest(least(round_even(l_discount * 1000000, 0), 32767), -32768)::SMALLINT AS scaled FROM lineitem")
def viz_rounding(spark, d):
    """Three significant figures, and a value scaled to a clipped short."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", ag.significant(F.col("l_extendedprice")).alias("price"), F.greatest(F.least(F.rint(F.col("l_discount") * 1000000), F.lit(32767.0)), F.lit(-32768.0)).cast("short").alias("scaled"))


# ---------------------------------------------------------------- validation
OK_SQL = "(predicted IS NOT NULL AND reference IS NOT NULL AND coalesce(coverage, 0) >= 0.5)"
_area = lambda a: f"coalesce(sum(area) FILTER ({a}), 0.0)"
_share = lambda part, whole: f"round(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0 END, 6)::DOUBLE"
_rate = lambda a, b: _share(_area(f"{OK_SQL} AND {a}"), _area(f"{OK_SQL} AND {b}"))


@query(f"""SELECT count(*) AS n_units, count(*) FILTER (predicted IS NULL) AS no_prediction, count(*) FILTER (predicted IS NOT NULL AND reference IS NULL) AS no_reference,
count(*) FILTER (predicted IS NOT NULL AND reference IS NOT NULL AND coalesce(coverage, 0) < 0.5) AS low_coverage, count(*) FILTER ({OK_SQL}) AS n_compared, count(*) FILTER ({OK_SQL} AND predicted <> reference) AS n_disagree, {_area(OK_SQL)} AS area_compared,
{_rate("predicted = reference", "true")} AS overall, {_rate("reference <= 10 AND predicted = reference", "reference <= 10")} AS built, {_rate("reference > 10 AND predicted = reference", "reference > 10")} AS natural,
{_rate("(reference <= 10) = (predicted <= 10)", "true")} AS built_or_natural, {_rate("reference > 10", "true")} AS natural_share FROM {LB}""")
def agreement_summary(spark, d):
    return ag.summary(city.relation(spark, d, "labels2"))


CONFUSION_SQL = f"SELECT reference, predicted, count(*) AS n, sum(area) AS area FROM {LB} WHERE {OK_SQL} GROUP BY 1, 2"


@query(CONFUSION_SQL)
def confusion(spark, d):
    return ag.confusion(city.relation(spark, d, "labels2"))


@query(f"""WITH k AS (SELECT * FROM {LB} WHERE {OK_SQL}),
r AS (SELECT reference AS code, count(*) AS n_reference, sum(area) AS area_reference, count(*) FILTER (predicted = reference) AS n_agree, {_area("predicted = reference")} AS area_agree FROM k GROUP BY 1),
p AS (SELECT predicted AS code, count(*) AS n_predicted, sum(area) AS area_predicted FROM k GROUP BY 1),
j AS (SELECT code, coalesce(n_reference, 0) AS n_reference, coalesce(area_reference, 0.0) AS area_reference, coalesce(n_agree, 0) AS n_agree, coalesce(area_agree, 0.0) AS area_agree, coalesce(n_predicted, 0) AS n_predicted, coalesce(area_predicted, 0.0) AS area_predicted FROM r FULL JOIN p USING (code)),
a AS (SELECT *, CASE WHEN area_reference > 0 THEN area_agree / area_reference ELSE 0.0 END AS pa, CASE WHEN area_predicted > 0 THEN area_agree / area_predicted ELSE 0.0 END AS ua FROM j)
SELECT code, n_reference, area_reference, n_agree, area_agree, n_predicted, area_predicted, round(pa, 6) AS producer, round(ua, 6) AS "user", round(CASE WHEN ua + pa > 0 THEN 2 * ua * pa / (ua + pa) ELSE 0.0 END, 6) AS f1 FROM a""")
def agreement_per_class(spark, d):
    return ag.per_class(city.relation(spark, d, "labels2"))


@query(f"""WITH w AS (SELECT reference, predicted, area FROM {LB} WHERE {OK_SQL} AND predicted <> reference), x(a, b) AS (VALUES {", ".join(map(str, (*ag.COMPACTNESS, *ag.HEIGHT)))}), t AS (SELECT count(*) AS m, sum(area) AS s FROM w),
e AS (SELECT a, b, count(*) FILTER (reference = a AND predicted = b) AS n_forward, count(*) FILTER (reference = b AND predicted = a) AS n_backward, {_area("(reference = a AND predicted = b) OR (reference = b AND predicted = a)")} AS area FROM x, w GROUP BY 1, 2)
SELECT a, b, n_forward, n_backward, n_forward + n_backward AS n_total, round((n_forward + n_backward)::DOUBLE / m, 6) AS share_of_disagreement, round(area / s, 6) AS share_of_disagreement_area FROM e, t""")
def axis_pairs(spark, d):
    return ag.axis_pairs(city.relation(spark, d, "labels2"), (*ag.COMPACTNESS, *ag.HEIGHT))


_AXES = [(f"'{name}'", x, y) for name, axis in (("compactness", ag.COMPACTNESS), ("height", ag.HEIGHT)) for a, b in axis for x, y in ((a, b), (b, a))]


@query(f"""WITH w AS (SELECT reference, predicted, area FROM {LB} WHERE {OK_SQL} AND predicted <> reference), x(axis, r, p) AS (VALUES {", ".join(f"({n}, {a}, {b})" for n, a, b in _AXES)}), t AS (SELECT count(*)::DOUBLE AS m, sum(area) AS s FROM w),
q AS (SELECT predicted, count(*) / any_value(m) AS q FROM w, t GROUP BY 1), n AS (SELECT reference, count(*) / any_value(m) AS f FROM w, t GROUP BY 1),
c AS (SELECT x.axis, sum(n.f * q.q / (1 - coalesce(o.q, 0))) AS expected FROM x JOIN n ON n.reference = x.r JOIN q ON q.predicted = x.p LEFT JOIN q o ON o.predicted = x.r WHERE coalesce(o.q, 0) < 1 GROUP BY 1),
b AS (SELECT axis, count(w.reference) AS n_total, coalesce(sum(w.area), 0.0) AS area FROM x LEFT JOIN w ON w.reference = x.r AND w.predicted = x.p GROUP BY 1), g AS (SELECT count(*) AS n_axis_eligible FROM w WHERE reference IN (SELECT r FROM x))
SELECT b.axis, n_total, round(n_total / m, 6) AS share_of_disagreement, round(area / s, 6) AS share_of_disagreement_area, n_axis_eligible, round(n_total::DOUBLE / n_axis_eligible, 6) AS share_of_axis_eligible, round(expected, 6) AS expected_share, round(n_total / m / expected, 6) AS lift
FROM b, c, t, g WHERE b.axis = c.axis""")
def axis_lift(spark, d):
    return ag.axis_lift(city.relation(spark, d, "labels2"))


@query(f"WITH s(reference, predicted, w) AS (VALUES {', '.join(f'({a}, {b}, {w}::DOUBLE)' for (a, b), w in similarity().items())}) SELECT round(sum(n * w) / sum(n), 6)::DOUBLE AS weighted_agreement FROM ({CONFUSION_SQL}) JOIN s USING (reference, predicted)")
def weighted_agreement(spark, d):
    """Agreement weighted by the published similarity of classes."""
    return ag.weighted_agreement(city.relation(spark, d, "labels2"), similarity_table(spark))


@query(f"""WITH k AS (SELECT least(floor(completeness * 10), 9)::INTEGER AS band, area, predicted = reference AS same FROM {LB} WHERE {OK_SQL} AND completeness BETWEEN 0 AND 1)
SELECT b.band, count(k.band) AS n, coalesce(sum(area), 0.0) AS area, round(CASE WHEN sum(area) > 0 THEN {_area("same")} / sum(area) ELSE 0.0 END, 6) AS agreement FROM (SELECT unnest(range(10))::INTEGER AS band) b LEFT JOIN k USING (band) GROUP BY 1""")
def agreement_strata(spark, d):
    """By completeness of heights."""
    return ag.strata(city.relation(spark, d, "labels2"))


@query(f"""WITH r AS (SELECT predicted, measure, sum(weight) OVER (PARTITION BY predicted ORDER BY measure) AS run, sum(weight) OVER (PARTITION BY predicted) AS total FROM {LB} WHERE measure IS NOT NULL)
SELECT predicted, min(measure) FILTER (run >= 0.1 * total) AS q10, min(measure) FILTER (run >= 0.5 * total) AS q50, min(measure) FILTER (run >= 0.9 * total) AS q90 FROM r GROUP BY 1""")
def published_ranges(spark, d):
    return ag.weighted_quantiles(city.relation(spark, d, "labels2"), "predicted", "measure", "weight", "unit", (0.1, 0.5, 0.9))


@query(f"""WITH k AS (SELECT city, measure AS x, weight AS y FROM {LB} WHERE measure IS NOT NULL), r AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY x) + (count(*) OVER (PARTITION BY city, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY city ORDER BY y) + (count(*) OVER (PARTITION BY city, y) - 1) / 2.0 AS ry FROM k)
SELECT city, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0""")
def within_unit_spearman(spark, d):
    return ag.spearman_within(city.relation(spark, d, "labels2"), "city", "measure", "weight")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_totalprice DESC, o_orderkey)::INTEGER AS priority FROM orders")
def priority_order(spark, d):
    """Newest first, unknown dates last, then the more accurate, then the id; within each overlap group."""
    date = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    order = Window.partitionBy("o_custkey").orderBy(date.desc_nulls_last(), F.desc("o_totalprice"), "o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.row_number().over(order).alias("priority"))


SWEEP_SQL = f"""SELECT t / 20.0::DOUBLE AS threshold, count(*) FILTER (coverage > t / 20.0 AND reference <= 5) AS tp, count(*) FILTER (coverage > t / 20.0 AND reference > 5) AS fp, count(*) FILTER (NOT coverage > t / 20.0 AND reference <= 5) AS fn
FROM (SELECT * FROM {LB} WHERE coverage IS NOT NULL AND reference IS NOT NULL), (SELECT unnest(range(1, 20)) AS t) GROUP BY t"""


def _sweep(spark, d):
    known = city.relation(spark, d, "labels2").where("coverage is not null and reference is not null")
    # each row meets a fixed list of thresholds, summed before any shuffle
    each = known.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(19))))
    over, real = F.col("coverage") > F.col("t") / 20.0, F.col("reference") <= 5
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return each.groupBy((F.col("t") / 20.0).alias("threshold")).agg(n(over & real).alias("tp"), n(over & ~real).alias("fp"), n(~over & real).alias("fn"))


RATES_SQL = f"SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision_, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM ({SWEEP_SQL})"


@query(RATES_SQL)
def threshold_sweep(spark, d):
    return _sweep(spark, d).select("*", ag.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_"), ag.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


@query(f"SELECT threshold, precision_, recall FROM ({RATES_SQL}) WHERE precision_ IS NOT NULL ORDER BY CASE WHEN precision_ >= 0.5 THEN 0 ELSE 1 END, CASE WHEN precision_ >= 0.5 THEN recall ELSE precision_ END DESC, threshold LIMIT 1")
def operating_point(spark, d):
    """The most recall at a least precision, else the most precise."""
    rates = QUERIES["threshold_sweep"](spark, d).where("precision_ is not null")
    good = F.col("precision_") >= 0.5
    return rates.orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col("recall")).otherwise(F.col("precision_")).desc(), "threshold").limit(1).select("threshold", "precision_", "recall")


@query("SELECT round(regr_slope(ln(n), ln(k)), 5) AS exponent FROM (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def scaling_exponent(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.regr_slope(F.ln("n"), F.ln("k")), 5).alias("exponent"))


@query(f"""WITH k AS (SELECT city, reference, sum(area) AS area, {_area("predicted = reference")} AS same FROM {LB} WHERE {OK_SQL} GROUP BY 1, 2)
SELECT city, round(max(area) / sum(area), 6) AS baseline, round(sum(same) / sum(area), 6) AS agreement, round(sum(same) / sum(area) - max(area) / sum(area), 6) AS above FROM k GROUP BY 1""")
def baseline_agreement(spark, d):
    return ag.above_baseline(city.relation(spark, d, "labels2"), "city")


@query(f"SELECT unit, round(CASE WHEN coverage < 0.2 THEN (0.2 - coverage) / 0.4 WHEN coverage > 0.6 THEN (coverage - 0.6) / 0.4 WHEN coverage IS NOT NULL THEN 0.0 END, 8)::DOUBLE AS gap FROM {LB}")
def normalised_gap(spark, d):
    """Distance to an interval in units of its width."""
    lo, hi = 0.2, 0.6
    return city.relation(spark, d, "labels2").select("unit", F.round(F.when(F.col("coverage").isNotNull(), zn.gap(F.col("coverage"), lo, hi) / 0.4), 8).alias("gap"))


# ---------------------------------------------------------------- places and projections
@query("SELECT upper(c_name) AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) AS normal, CASE WHEN lower(c_name) LIKE 'customer#0000001%' THEN true ELSE false END AS matches FROM customer")
def place_normalise(spark, d):
    normal = F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.upper("c_name").alias("name"), normal.alias("normal"), F.lower("c_name").startswith("customer#0000001").alias("matches"))


@query("SELECT n_name, CASE WHEN lower(n_name) = 'nation_1' THEN 0 ELSE 1 END AS tier, row_number() OVER (ORDER BY CASE WHEN lower(n_name) = 'nation_1' THEN 0 ELSE 1 END, n_nationkey)::INTEGER AS place FROM nation WHERE contains(lower(n_name), 'nation_1')")
def place_search(spark, d):
    """Exact names before names that contain the term, file order inside a tier."""
    term, name = "nation_1", F.lower("n_name")
    tier = F.when(name == term, 0).otherwise(1)
    found = spark.read.parquet(f"{d}/nation.parquet").where(name.contains(term)).withColumn("tier", tier)
    return found.select("n_name", "tier", F.row_number().over(Window.orderBy("tier", "n_nationkey")).alias("place"))


POINT_TEXT = "SELECT s_suppkey, -170.0 + (s_suppkey * 37) % 340 AS lon, -70.0 + (s_suppkey * 53) % 140 AS lat FROM {supplier}"
POINT_SQL = f"({POINT_TEXT.replace('{supplier}', 'supplier')})"


def _points(spark, d):
    return spark.sql(POINT_TEXT, supplier=spark.read.parquet(f"{d}/supplier.parquet")).selectExpr("s_suppkey", "cast(lon AS double) AS lon", "cast(lat AS double) AS lat")


@query(f"SELECT s_suppkey, (floor((lon + 180) / 6) + 1)::INTEGER AS zone, (CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6) + 1)::INTEGER AS epsg, format('{{}}{{:02d}}{{}}{{:03d}}', CASE WHEN lat < 0 THEN 'S' ELSE 'N' END, abs(floor(lat / 3) * 3)::INTEGER, CASE WHEN lon < 0 THEN 'W' ELSE 'E' END, abs(floor(lon / 3) * 3)::INTEGER) AS tile FROM {POINT_SQL}")
def landcover_tiles(spark, d):
    """The projected zone of a point and the three-degree tile that holds it."""
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    three = lambda c: F.abs(F.floor(F.col(c) / 3) * 3).cast("int")
    tile = F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.lpad(three("lat"), 2, "0"), F.when(F.col("lon") < 0, "W").otherwise("E"), F.lpad(three("lon"), 3, "0"))
    return _points(spark, d).select("s_suppkey", zone.alias("zone"), (F.when(F.col("lat") < 0, 32700).otherwise(32600) + zone).alias("epsg"), tile.alias("tile"))


@query(f"SELECT s_suppkey, round(0.5 * 111.32 * cos(radians(lat + 0.1)) * 0.2 * 110.57, 6) AS area_km2 FROM {POINT_SQL}")
def bbox_area(spark, d):
    """Area of a box of half by a fifth degree with cosine-corrected constants."""
    return _points(spark, d).select("s_suppkey", F.round(F.lit(0.5) * 111.32 * F.cos(F.radians(F.col("lat") + 0.1)) * 0.2 * 110.57, 6).alias("area_km2"))


@query(f"SELECT s_suppkey, floor(lon * 1000 / 750)::BIGINT AS bx, floor(lat * 1000 / 750)::BIGINT AS by_ FROM {POINT_SQL}")
def spatial_blocks(spark, d):
    """Blocks by floor division, negative coordinates included."""
    return _points(spark, d).select("s_suppkey", F.floor(F.col("lon") * 1000 / 750).alias("bx"), F.floor(F.col("lat") * 1000 / 750).alias("by_"))


@query(f"""WITH t AS (SELECT DISTINCT x0 // 400 AS tx, y0 // 400 AS ty FROM {B}) SELECT t.tx, t.ty, b.part_id, b.x0 // 400 = t.tx AND b.y0 // 400 = t.ty AS core FROM t JOIN {B} b ON b.x0 < (t.tx + 1) * 400 + 60 AND b.x1 > t.tx * 400 - 60 AND b.y0 < (t.ty + 1) * 400 + 60 AND b.y1 > t.ty * 400 - 60""")
def tile_assignment(spark, d):
    """Tiles with a buffered window: each building in one core, and in every window it reaches."""
    b = city.relation(spark, d, "buildings")
    tiles = b.select(F.floor(F.col("x0") / 400).alias("tx"), F.floor(F.col("y0") / 400).alias("ty")).distinct()
    reach = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - 60) / 400) , F.floor((F.col(hi) + 60) / 400)))
    near = b.withColumn("tx", reach("x0", "x1")).withColumn("ty", reach("y0", "y1"))
    inside = (F.col("x0") < (F.col("tx") + 1) * 400 + 60) & (F.col("x1") > F.col("tx") * 400 - 60) & (F.col("y0") < (F.col("ty") + 1) * 400 + 60) & (F.col("y1") > F.col("ty") * 400 - 60)
    return near.where(inside).join(tiles, ["tx", "ty"]).select("tx", "ty", "part_id", ((F.floor(F.col("x0") / 400) == F.col("tx")) & (F.floor(F.col("y0") / 400) == F.col("ty"))).alias("core"))


@query(f"""SELECT a.part_id AS a, b.part_id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))::DOUBLE AS area FROM {B} a JOIN {B} b ON a.part_id < b.part_id AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0""")
def overlapping_pairs(spark, d):
    """Unordered pairs of parts that overlap; a shared edge is no overlap."""
    b = city.relation(spark, d, "buildings").select("part_id", "x0", "y0", "x1", "y1")
    left = b.select(F.col("part_id").alias("a"), *[F.col(c).alias(f"u{c}") for c in ("x0", "y0", "x1", "y1")])
    return ov.overlay_boxes(left, b.withColumnRenamed("part_id", "b"), 50).where("a < b").select("a", "b", F.col("piece_area").alias("area"))


@query(f"SELECT l.land_id FROM {L} l WHERE NOT EXISTS (SELECT 1 FROM {B} b WHERE b.x0 < l.x1 AND b.x1 > l.x0 AND b.y0 < l.y1 AND b.y1 > l.y0)")
def spatial_anti_join(spark, d):
    """Parcels that no building overlaps."""
    parcels = city.relation(spark, d, "land_use")
    as_units = parcels.select("land_id", F.col("x0").alias("ux0"), F.col("y0").alias("uy0"), F.col("x1").alias("ux1"), F.col("y1").alias("uy1"))
    hit = ov.overlay_boxes(as_units, city.relation(spark, d, "buildings")).select("land_id").distinct()
    return parcels.select("land_id").join(hit, "land_id", "left_anti")


# ---------------------------------------------------------------- labels from patches, components, resampling, windows
@query(f"""WITH p AS (SELECT part_id, 1 + part_id % 17 AS label, x0 + x1 AS px, y0 + y1 AS py FROM {B}),
m AS (SELECT p.part_id, p.label, l.land_id, count(*) OVER (PARTITION BY p.part_id) AS n FROM p JOIN {L} l ON px > 2 * l.x0 AND px < 2 * l.x1 AND py > 2 * l.y0 AND py < 2 * l.y1)
SELECT part_id, label, land_id FROM m WHERE n = 1""")
def label_by_centre(spark, d):
    """The parcel that holds a patch's centre strictly inside; patches in several parcels are ambiguous and, as those in none, dropped."""
    patches = city.relation(spark, d, "buildings").select("part_id", (1 + F.col("part_id") % 17).alias("label"), (F.col("x0") + F.col("x1")).alias("px"), (F.col("y0") + F.col("y1")).alias("py"))
    units = city.relation(spark, d, "land_use").select("land_id", F.col("x0").alias("ux0"), F.col("y0").alias("uy0"), F.col("x1").alias("ux1"), F.col("y1").alias("uy1"))
    found = ov.points_in_boxes(patches, units)
    return found.groupBy("part_id", "label").agg(F.min("land_id").alias("land_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH a AS (SELECT unit_id, unit_area, 1 + p_size % 17 AS label, sum(piece_area) AS area FROM {PL} GROUP BY 1, 2, 3)
SELECT unit_id, arg_max(label, area * 100 - label) AS label, least(1.0, sum(area) / any_value(unit_area)) AS coverage FROM a GROUP BY 1""")
def label_by_area(spark, d):
    """The class with the largest area in a cell, the lower code of equal ones; the covered share is at most 1."""
    area = _land_pieces(spark, d).groupBy("unit_id", "unit_area", (1 + F.col("p_size") % 17).alias("label")).agg(F.sum("piece_area").alias("area"))
    return area.groupBy("unit_id").agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"), F.least(F.lit(1.0), F.sum("area") / F.first("unit_area")).alias("coverage"))


@query(f"""WITH RECURSIVE e AS (SELECT a.part_id AS a, b.part_id AS b FROM {B} a JOIN {B} b ON a.part_id <> b.part_id AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def connected_overlap_components(spark, d):
    """Parts that overlap another, with the least part of their component; a shared edge is no overlap."""
    return gr.connected(QUERIES["overlapping_pairs"](spark, d))


STEPS = [i / 20 for i in range(1, 20)]
DRAW = "(r * 31 + block * 17 + r * block) % 3"


@query(f"""WITH b AS (SELECT city AS block, sum(weight) AS w, sum(CASE WHEN predicted = reference THEN weight ELSE 0 END) AS hit FROM {LB} WHERE reference IS NOT NULL GROUP BY 1),
s AS (SELECT r, sum(hit * ({DRAW})) / nullif(sum(w * ({DRAW})), 0) AS score FROM b, (SELECT unnest(range(200)) AS r) GROUP BY r)
SELECT count(score) AS draws, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.5), 6) AS middle, round(quantile_cont(score, 0.975), 6) AS high FROM s""")
def bootstrap_draw_scores(spark, d):
    """Percentile interval of the weighted agreement over a fixed table of block draws: units are summed by block before any draw."""
    rows = city.relation(spark, d, "labels2").where("reference is not null")
    blocks = rows.groupBy(F.col("city").alias("block")).agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("weight")).otherwise(0.0)).alias("hit"))
    drawn = blocks.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("m", F.expr(DRAW))
    score = drawn.groupBy("r").agg((F.sum(F.col("hit") * F.col("m")) / F.nullif(F.sum(F.col("w") * F.col("m")), F.lit(0.0))).alias("score"))
    at = lambda q: F.round(F.percentile("score", F.lit(q)), 6)
    return score.agg(F.count("score").alias("draws"), at(0.025).alias("low"), at(0.5).alias("middle"), at(0.975).alias("high"))


@query(f"""WITH p AS (SELECT (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM {B}),
k AS (SELECT quantile_cont(x, {STEPS}) AS xs, quantile_cont(y, {STEPS}) AS ys FROM p), q AS (SELECT unnest(range(1, 20)) AS i, unnest(xs) AS cx, unnest(ys) AS cy FROM k)
SELECT a.i, b.i AS j, round(a.cx, 6) AS cx, round(b.cy, 6) AS cy, count(*) AS n FROM q a, q b, p WHERE abs(x - a.cx) <= 200 AND abs(y - b.cy) <= 200 GROUP BY ALL ORDER BY n DESC, a.i, b.i LIMIT 1""")
def densest_window(spark, d):
    """Of 19 by 19 windows at quantiles of the centres the first that holds most centres; the report is one row."""
    centres = city.relation(spark, d, "buildings").select(((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    steps = F.array(*map(F.lit, STEPS))
    xs, ys = centres.agg(F.percentile("x", steps), F.percentile("y", steps)).first()
    if xs is None:
        return centres.selectExpr("1 AS i", "1 AS j", "x AS cx", "y AS cy", "1L AS n").limit(0)
    listed = lambda values: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("c")) for i, v in enumerate(values, 1)])
    near = centres.withColumn("a", F.explode(F.filter(listed(xs), lambda s: F.abs(F.col("x") - s["c"]) <= 200)))
    near = near.withColumn("b", F.explode(F.filter(listed(ys), lambda s: F.abs(F.col("y") - s["c"]) <= 200)))
    counts = near.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.round("a.c", 6).alias("cx"), F.round("b.c", 6).alias("cy")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "i", "j").limit(1)
