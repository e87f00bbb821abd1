"""The driver contract, and a few queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from morphogrid.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rounded(row):
    return tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["overlay_pieces", "height_moments", "covered_fraction_dissolved", "surface_fractions", "classify_units", "modal_filter", "class_indistinguishable", "normalised_gap", "axis_lift", "tile_assignment", "label_by_centre", "label_by_area", "connected_overlap_components", "bootstrap_draw_scores", "densest_window"])
def test_query_equals_its_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF), sql.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr(rounded(r[c] for c in columns)) for r in got.collect()) == sorted(repr(rounded(r[i] for i in place)) for r in want.fetchall())
