"""Worked values of the diagnostics, record attributes and the gazetteer."""

import datetime

import pytest
from pyspark.sql import functions as F

from morphogrid.operators import diagnostics as dg
from morphogrid.operators import places as pl
from morphogrid.operators import records as rc
from morphogrid.operators import zones as zn


def test_a_height_without_an_entry_of_its_own_takes_the_footprints_dataset(spark):
    entry = "array<struct<property: string, dataset: string, confidence: double>>"
    rows = [(1, None), (2, [("", "a", None)]), (3, [(None, "a", 0.9), ("/properties/height", "b", 0.5)]), (4, [("/properties/height", None, 0.2), ("", "a", None)]), (5, [])]
    f = spark.createDataFrame(rows, f"id int, s {entry}").select("id", *dg.height_attribution(F.col("s")))
    assert [tuple(r)[1:] for r in f.orderBy("id").collect()] == [(None, None), ("a", None), ("b", 0.5), ("a", 0.2), (None, None)]


def test_dispersion_gates_units_and_breaks_ties_by_order(spark):
    rows = [(0.5, 3, 2.0, 10.0, 0.5, 0.5), (0.5, 3, 0.0, 10.0, 0.2, None), (0.04, 9, 5.0, 5.0, 1.0, 0.0), (0.5, 2, 5.0, 5.0, 1.0, 0.0), (0.5, 3, None, 5.0, 1.0, 0.0), (0.5, 3, 5.0, 5.0, None, None), (0.5, 5, 4.0, 0.0, 0.1, 0.9)]
    f = spark.createDataFrame(rows, "building_surface_fraction double, building_count int, h_std double, h_mean_area_weighted double, height_frac_a double, height_frac_b double")
    got = {r.height_source: tuple(r)[1:] for r in dg.dispersion(f, ("a", "b")).collect()}
    assert got == {"a": (2, 1.0, 0.1, 0.5), "b": (1, 4.0, None, 0.0)}


def test_labels_of_one_run_only_have_moved(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "unit_id string, label int")
    other = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("e", 5)], "unit_id string, label int")
    moved = dg.flips(one, other)
    assert tuple(dg.flip_summary(moved).first()) == (4, 3, 0.75, False) and [tuple(r) for r in dg.transitions(moved).collect()] == [(2, 3, 1)]
    assert tuple(dg.flip_summary(moved.where("false")).first()) == (0, 0, 0.0, True)


def test_implausible_heights(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("a", None), ("b", None)], "height_source string, height double")
    assert [tuple(r) for r in dg.implausible(f).collect()] == [("a", 4, 0.25, 0.5, 2.5)]


def test_flags_and_dates_in_several_spellings(spark):
    rows = [("True", "t", "1", "2019-03-01"), ("F", None, "1", "01.03.2019"), (" T ", "yes", "1", "soon"), ("T", "T", None, None)]
    f = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [tuple(r) for r in f.select(rc.passed([F.col(c) for c in "abc"]), rc.date(F.col("d"))).collect()]
    day = datetime.date(2019, 3, 1)
    assert got == [(True, day), (False, day), (None, None), (None, None)]


def test_an_unknown_height_vetoes_nothing(spark):
    f = spark.createDataFrame([(5.0, 1.0), (None, 1.0), (10.0, 1.0)], "h double, lcz_d1 double")
    assert [r.lcz_d1 for r in zn.without_short(f, F.col("h"), 10.0).collect()] == [None, 1.0, 1.0]
    assert zn.without_short(f, F.col("h"), None) is f and zn.height_dependent_weight() == [("built", 9.0, 17.0), ("natural", 2.0, 7.0)]


@pytest.fixture(scope="module")
def gazetteer(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("places") / "places.csv"
    lines = ["1,East London,ZAF,South Africa", "2,London,GBR,United Kingdom", "3,London,CAN,Canada", "4,São Paulo,BRA,Brazil", "5,Washington D.C.,USA,United States"]
    path.write_text("\n".join(["SMOD_ID,JRC_NAME_MAIN,ISO,CNTRY_NAME,minx,miny,maxx,maxy", *(f"{line},0,1,2.5,3" for line in lines)]), encoding="utf-8")
    return pl.load(spark, str(path))


def test_places_are_found_by_key_exact_names_first(gazetteer):
    names = lambda *a: [r.place_id for r in pl.find(gazetteer, *a).orderBy("tier", "ord").collect()]
    assert names("london") == ["2", "3", "1"] and names("LONDON", "gb") == ["2"] and names("") == ["1", "2", "3", "4", "5"] and names("paris") == []
    assert pl.resolve(gazetteer, "sao paulo").name == "São Paulo" and pl.resolve(gazetteer, "washington dc").x1 == 2.5 and pl.resolve(gazetteer, "london", "united k").iso == "GBR"


def test_no_place_and_several_raise(gazetteer, spark, tmp_path):
    with pytest.raises(LookupError, match="several places: .*GBR.*CAN"):
        pl.resolve(gazetteer, "London")
    with pytest.raises(LookupError, match="no place"):
        pl.resolve(gazetteer, "Paris")
    (tmp_path / "odd.csv").write_text("SMOD_ID,ISO\n1,GBR\n")
    with pytest.raises(ValueError, match="JRC_NAME_MAIN"):
        pl.load(spark, str(tmp_path / "odd.csv"))
