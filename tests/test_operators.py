"""Null discipline, worked values and invariants of the relational operators on hand-made frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from morphogrid.operators import agreement as ag
from morphogrid.operators.similarity import similarity, similarity_table
from morphogrid.operators import heights as ht
from morphogrid.operators import overlay as ov
from morphogrid.operators import zones as zn


@pytest.fixture(scope="module")
def pieces(spark):
    units = ov.grid(spark, 2, 100)
    layer = spark.createDataFrame([(1, 1, 90, 10, 110, 30, 10.0), (2, 1, 120, 10, 130, 20, 10.0), (3, 2, 10, 10, 20, 20, 20.0), (4, 3, 100, 100, 110, 110, None)], "part_id int, feature_id int, x0 long, y0 long, x1 long, y1 long, height double")
    return units, ov.overlay_boxes(units, layer)


def test_a_straddling_box_is_split_and_touching_boxes_are_not(pieces):
    got = {(r.unit_id, r.part_id): r.piece_area for r in pieces[1].collect()}
    assert got == {("grid_0_0", 1): 200.0, ("grid_1_0", 1): 200.0, ("grid_1_0", 2): 100.0, ("grid_0_0", 3): 100.0, ("grid_1_1", 4): 100.0}


def test_overlay_is_never_a_nested_loop(pieces):
    plan = pieces[1]._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_empty_cells_measure_zero_and_their_shares_are_unknown(pieces):
    units, p = pieces
    area = p.groupBy("unit_id").agg(F.sum("piece_area").alias("a"), F.sum(F.lit(1.0)).alias("n"))
    filled = {r.unit_id: r for r in ov.zero_filled(units, area, ["a"]).select("unit_id", "a", ov.share(F.lit(1.0), F.col("a")).alias("s")).collect()}
    assert filled["grid_0_1"].a == 0.0 and filled["grid_0_1"].s is None and filled["grid_0_0"].a == 300.0


def test_parts_of_a_feature_have_one_vote(pieces):
    got = {r.unit_id: r for r in ht.moments(pieces[1]).collect()}
    assert got["grid_0_0"].height_of_roughness_elements_m == pytest.approx(math.sqrt(200), abs=1e-6)
    assert got["grid_1_0"].height_of_roughness_elements_m == pytest.approx(10.0) and "grid_1_1" not in got


def test_height_floor_enters_the_geometric_mean_only(spark):
    p = spark.createDataFrame([("u", 1, 50.0, 0.0), ("u", 2, 50.0, 10.0)], "unit_id string, feature_id int, piece_area double, height double")
    row = ht.moments(p).first()
    assert row.height_of_roughness_elements_m == pytest.approx(1.0) and row.h_mean_area_weighted == 5.0 and row.h_std == 5.0


def test_union_area_counts_overlaps_once():
    boxes = pd.DataFrame([(0, 0, 50, 100), (0, 0, 50, 100), (25, 0, 75, 10)], columns=["x0", "y0", "x1", "y1"])
    assert ov.union_area(boxes) == 5000 + 25 * 10


def test_transfer_and_diluted_treat_unknowns_differently(spark):
    p = spark.createDataFrame([("z", 1, 30.0, 4.0, "a"), ("z", 2, 10.0, None, "b"), ("z", 3, 30.0, 8.0, "c")], "zone string, ord int, piece_area double, v double, k string")
    kept, mixed = ov.transfer(p, "zone", ["v"], ["k"], "ord").first(), ov.diluted(p, "zone", ["v"]).first()
    assert (kept.v, kept.k, kept.overlap_area) == (6.0, "a", 70.0) and mixed.v == pytest.approx(360 / 70)
    best = ov.largest(p.withColumn("v", F.when(F.col("ord") > 1, F.col("v"))), "zone", ["v", "k"], "ord").first()
    assert (best.v, best.k) == (None, "a")


def test_normalisation_constants():
    got = zn.normalisation()
    assert got["aspect_ratio"] == pytest.approx((0.6857142857142859, 0.5924912812585067), abs=1e-12)
    assert got["building_sf"] == pytest.approx((0.3259259259259259, 0.22042482987209647), abs=1e-12)
    assert got["height_m"] == pytest.approx((9.711538461538462, 8.991366667877193), abs=1e-12)
    assert got["pervious_sf"] == pytest.approx((0.5045454545454546, 0.28994869879667384), abs=1e-12)
    assert got["water_sf"] == pytest.approx((0.15714285714285717, 0.13997084244475305), abs=1e-12)
    assert got["mean_area_m2"] == (300.0, 200.0)


@pytest.fixture(scope="module")
def classified(spark):
    rows = [("a", 0.5, 0.30, 14.0, None), ("b", None, 0.45, 6.0, 0.45), ("c", None, 0.45, 6.0, 0.4501), ("d", None, 0.05, None, None), ("e", None, 0.1, None, 0.9)]
    frame = spark.createDataFrame(rows, "unit_id string, ar double, bsf double, hr double, ind double")
    return {r.unit_id: r for r in zn.classify(frame, {"aspect_ratio": "ar", "building_sf": "bsf", "height_m": "hr"}, "ind").collect()}


def test_worked_distances(classified):
    a, b = classified["a"], classified["b"]
    assert (a.lcz_d5, a.lcz_d10) == (0, 0)
    for code, want in ((6, 0.264293), (8, 0.299931), (2, 0.358153), (3, 0.445111), (9, 0.445111), (4, 0.748107), (7, 1.197469), (1, 1.325207)):
        assert a[f"lcz_d{code}"] == pytest.approx(want, abs=2e-6)
    assert b.lcz_primary == 3 and b.lcz_secondary == 8 and b.n_tied_classes == 2 and b.uniqueness == 0.0
    assert b.lcz_d6 == pytest.approx(0.171471, abs=2e-6) and b.missing_parameters == "aspect_ratio"


def test_industrial_rule_is_strict_and_displaces(classified):
    assert classified["b"].label_route == "built"
    c = classified["c"]
    assert (c.lcz_primary, c.lcz_secondary, c.min_distance, c.uniqueness, c.label_route) == (10, 3, None, None, "industrial")
    assert classified["d"].label_route == "natural" and classified["e"].label_route == "industrial"


def test_a_unit_without_building_share_raises(spark):
    frame = spark.createDataFrame([("a", None)], "unit_id string, bsf double")
    with pytest.raises(Exception, match="no building share"):
        zn.classify(frame, {"building_sf": "bsf"}).collect()


def test_modal_filter_ties_and_protection(spark):
    labels = spark.createDataFrame([("m", 9, False), ("p", 9, True), ("x", 2, False), ("y", 5, False)], "unit_id string, label int, protected boolean")
    edges = spark.createDataFrame([(a, b) for a in ("m", "p") for b in ("x", "y")], "unit_id string, neighbour string")
    got = {r.unit_id: r.smoothed for r in zn.modal_filter(labels, edges).collect()}
    assert got == {"m": 2, "p": 9, "x": 2, "y": 5}


def test_later_rules_win(spark):
    label, rule = zn.ordered_rules(F.col("l"), [("first", F.col("v") > 1, 8), ("second", F.col("v") > 2, 7)])
    got = [tuple(r) for r in spark.createDataFrame([(3, 1.5), (3, 5.0), (3, None)], "l int, v double").select(label, rule).collect()]
    assert got == [(8, "first"), (7, "second"), (3, None)]


def test_cascade_order_and_unresolved(spark):
    f = spark.createDataFrame([(5.0, 2), (0.0, 3), (None, 0), (float("nan"), None)], "h double, n int")
    height, _ = ht.attribute_tier(F.col("h"), F.col("n"))
    got = [(r.filled_height, r.height_source) for r in ht.cascade(f, [("attribute", height, 0.0)]).collect()]
    assert got == [(5.0, "attribute"), (9.0, "attribute"), (None, "unresolved"), (None, "unresolved")]


def test_weighted_quantile_takes_the_lower_candidate(spark):
    f = spark.createDataFrame([("g", 1.0, 1.0, 1), ("g", 2.0, 1.0, 2), ("g", 3.0, 8.0, 3), ("g", None, 5.0, 4)], "g string, v double, w double, id int")
    row = ag.weighted_quantiles(f, "g", "v", "w", "id", (0.1, 0.5)).first()
    assert (row.q10, row.q50) == (1.0, 3.0)


def test_strata_keep_empty_bands_and_close_the_last(spark):
    f = spark.createDataFrame([(1.0, 1, 1, 1.0, 300.0), (0.95, 1, 2, 1.0, 100.0), (0.05, 2, 2, 1.0, 7.0), (0.05, 2, 1, 0.4, 9.0), (None, 1, 1, 1.0, 5.0)], "completeness double, predicted int, reference int, coverage double, area double")
    got = {r.band: (r.n, r.area, r.agreement) for r in ag.strata(f).collect()}
    assert got[9] == (2, 400.0, 0.75) and got[0] == (1, 7.0, 1.0) and got[4] == (0, 0.0, 0.0) and len(got) == 10


def test_agreement_by_area(spark):
    rows = [(1, 1, 1.0, 300.0), (1, 2, 1.0, 100.0), (11, 11, 0.6, 50.0), (11, 1, 1.0, 50.0), (None, 3, 1.0, 9.0), (None, None, 1.0, 9.0), (3, None, 0.1, 9.0), (3, 3, 0.4, 9.0), (3, 3, None, 9.0)]
    f = spark.createDataFrame(rows, "predicted int, reference int, coverage double, area double")
    r = ag.summary(f).first()
    assert (r.n_units, r.no_prediction, r.no_reference, r.low_coverage, r.n_compared, r.n_disagree, r.area_compared) == (9, 2, 1, 2, 4, 2, 500.0)
    assert (r.overall, r.built, r.natural, r.built_or_natural, r.natural_share) == (0.7, round(300 / 450, 6), 1.0, 0.9, 0.1)
    empty = ag.summary(f.where("false")).first()
    assert empty.n_units == 0 and f.where("predicted is null").transform(ag.summary).first().overall == 0.0
    one = {x.code: x for x in ag.per_class(f).collect()}[1]
    assert (one.n_reference, one.n_predicted, one.producer, one.user, one.f1) == (2, 2, round(300 / 350, 6), 0.75, 0.8)


def test_similarity_weighs_near_misses(spark):
    weights = similarity_table(spark)
    w = similarity()
    assert len(w) == 289 and all(w[c, c] == 1.0 for c in range(1, 18)) and all(w[a, b] == w[b, a] for a, b in w)
    schema = "predicted int, reference int, coverage double, area double"
    score = lambda rows: ag.weighted_agreement(spark.createDataFrame(rows, schema), weights).first()[0]
    assert score([(2, 1, 1.0, 5.0)]) == 0.92 and score([(c, c, 1.0, 1.0) for c in range(1, 18)]) == 1.0 and score([(17, 1, 1.0, 1.0)]) == 0.0


def test_axis_lift_by_hand(spark):
    # four disagreements: 1 -> 4 twice (compactness), 1 -> 2 (height), 8 -> 4 (neither)
    rows = [(4, 1, 1.0, 10.0), (4, 1, 1.0, 30.0), (2, 1, 1.0, 20.0), (4, 8, 1.0, 40.0), (5, 5, 1.0, 99.0)]
    f = spark.createDataFrame(rows, "predicted int, reference int, coverage double, area double")
    got = {r.axis: r for r in ag.axis_lift(f).collect()}
    # q: 4 has 3/4, 2 has 1/4; references: 1 three times, 8 once; q of 1 and of 8 is 0
    assert (got["compactness"].n_total, got["compactness"].expected_share, got["compactness"].lift) == (2, round(0.75 * 0.75, 6), round(0.5 / 0.5625, 6))
    assert (got["height"].n_total, got["height"].expected_share, got["height"].lift) == (1, round(0.75 * 0.25, 6), round(0.25 / 0.1875, 6))
    assert got["height"].n_axis_eligible == 3 and got["compactness"].share_of_disagreement_area == 0.4
    pairs = {(r.a, r.b): (r.n_forward, r.n_backward, r.share_of_disagreement) for r in ag.axis_pairs(f, ag.COMPACTNESS).collect()}
    assert pairs == {(1, 4): (2, 0, 0.5), (2, 5): (0, 0, 0.0), (3, 6): (0, 0, 0.0)}


def test_significant_figures_round_half_to_even(spark):
    got = spark.createDataFrame([(12345.0,), (0.0,), (0.0012345,), (2.125,)], "v double").select(ag.significant(F.col("v"))).collect()
    assert [r[0] for r in got] == pytest.approx([12300.0, 0.0, 0.00123, 2.12])


def test_missing_vocabulary_is_no_match(spark):
    f = spark.createDataFrame([(None, "industrial"), ("x", None), (None, None)], "subtype string, class string")
    assert [r[0] for r in f.select(ht.selected(["industrial"], ["industrial"])).collect()] == [True, False, False]
    assert [r[0] for r in f.select(ht.tagged("subtype", "class")).collect()] == [True, True, False]


def test_components_of_paths_loops_and_nothing(spark):
    from morphogrid.operators.graph import connected

    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 50), (60, 60), (None, 3)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(31)} | {40: 40, 50: 40, 60: 60}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
