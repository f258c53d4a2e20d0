"""The semantic traps of the domain, a test for each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spatiotrack.constants import DEFAULTS
from spatiotrack.functions import geometry as g
from spatiotrack.operators import calibration as cal
from spatiotrack.operators import evaluation as ev
from spatiotrack.operators import readings as rd
from spatiotrack.operators import tracking as tk
from spatiotrack.operators import zones as zn
from spatiotrack.operators.tracking import Track, elect, publish, step

RECEIVER = "scanner string, floor_seq int, floor string, rec_seq int, x double, y double, height double, correction double, scale double"
ZONE = "floor_seq int, floor string, zone_seq int, zone_id string, zone string, poly boolean, no_go boolean, ring array<struct<x:double,y:double>>"
SUB = "floor_seq int, floor string, sub_seq int, sub_zone string, parent string, ring array<struct<x:double,y:double>>"


def receivers(spark, rows):
    return spark.createDataFrame([(n, 0, "f", k, x, y, h, c, 40.0) for k, (n, x, y, h, c) in enumerate(rows)], RECEIVER)


def states(spark, rows):
    """(tick, device, scanner, state)"""
    return spark.createDataFrame([(i, t, f"sensor.{d}_distance_to_{s}", v, "m") for i, (t, d, s, v) in enumerate(rows)], "event_id int, tick int, entity_id string, state string, unit string")


def test_t1_rank_by_slant_radius_by_horizontal(spark):
    r = receivers(spark, [("a", 0.0, 0.0, 4.0, 1.0)])
    row = rd.readings(states(spark, [(1, "d", "a", "5.0")]), r).first()
    assert row.slant == 5.0 and row.horizontal == 4.0 and row.r == 160.0
    assert rd.candidate_floors(rd.readings(states(spark, [(1, "d", "a", "5.0")]), r)).first().nearest_m == 5.0


def test_t2_and_t8_memory_of_radii(spark):
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0), ("b", 0.0, 0.0, None, 1.0)])
    rows = rd.readings(states(spark, [(1, "d", "a", "2.0"), (1, "d", "b", "3.0"), (7, "d", "a", "4.0")]), r)
    w = {(x.tick, x.scanner): x.previous_r for x in rd.with_jump_weights(rows).collect()}
    # The last one placed wins; fewer than three receivers are remembered too, over ticks without candidates.
    assert w == {(1, "a"): None, (1, "b"): None, (7, "a"): 120.0}


def test_t3_a_height_that_is_no_number_is_no_height(spark):
    r = receivers(spark, [("a", 0.0, 0.0, float("nan"), 1.0)])
    row = rd.readings(states(spark, [(1, "d", "a", "5.0")]), r).first()
    assert row.horizontal == row.slant == 5.0


def test_t4_negative_distances_count_live_but_not_in_calibration(spark):
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0)])
    assert rd.readings(states(spark, [(1, "d", "a", "-1.5")]), r).first().slant == -1.5
    adverts = spark.createDataFrame([(1, "A", "B", 5.0, -1.5), (1, "A", "B", 5.0, 1.5)], "dump int, address string, scanner_address string, stamp double, distance double")
    matches = spark.createDataFrame([("a", "x"), ("b", "y")], "address string, slug string")
    assert [x.distance_m for x in cal.ingest_dump(adverts, matches).collect()] == [1.5]


def test_t5_three_sensors_are_counted_over_all_devices(spark):
    s = states(spark, [(1, "d", "a", "1"), (1, "d", "b", "1"), (1, "e", "a", "1"), (2, "d", "a", "1"), (2, "e", "a", "1")])
    assert {x.tick for x in rd.enough_sensors(s).collect()} == {1}


def test_t6_ties_go_to_the_lower_floor():
    assert elect(Track(), {2: 0.5, 1: 0.5}) == 1


def test_t7_dark_grace_changes_nothing_but_its_counter():
    t = Track(probs={0: 0.7, 1: 0.3}, incumbent=0, rival=1, rival_count=2)
    assert elect(t, {1: 0.9}) is None
    assert (t.probs, t.incumbent, t.rival, t.rival_count, t.dark) == ({0: 0.7, 1: 0.3}, 0, 1, 2, 1)


def test_t9_first_step_is_the_share_without_small_floors():
    t = Track()
    elect(t, {0: 0.98, 1: 0.02})
    assert t.probs == {0: 1.0}
    t = Track()
    elect(t, {0: 0.9, 1: 0.1})
    assert t.probs == pytest.approx({0: 0.9, 1: 0.1})


def test_t10_the_filter_keeps_the_position_before_clipping():
    t = Track()
    fix = step(t, 1, {0: (1, 50.0, 60.0, 0.1, 0.9, 40.0, 0.0, 0.0, 20.0, 30.0)})
    assert fix[1:5] == (20.0, 30.0, 50.0, 60.0) and (t.kalman[2], t.kalman[4]) == (50.0, 60.0)


def test_t11_parent_zone_is_the_sub_zones_parent_or_the_zone(spark):
    box = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 400.0), (x0, 400.0)]
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0), ("b", 400.0, 0.0, None, 1.0), ("c", 0.0, 400.0, None, 1.0), ("e", 400.0, 400.0, None, 1.0)])
    zones = spark.createDataFrame([(0, "f", 0, "z0", "west", True, False, box(0.0, 200.0)), (0, "f", 1, "z1", "east", True, False, box(200.0, 400.0))], ZONE)
    subs = spark.createDataFrame([(0, "f", 0, "desk", "z1", box(0.0, 100.0))], SUB)
    rows = []
    for tick, (x, y) in enumerate([(50.0, 200.0), (150.0, 200.0)]):
        rows += [(tick * 100, f"d{tick}", n, f"{((x - u) ** 2 + (y - v) ** 2) ** 0.5 / 40:.6f}") for n, u, v in (("a", 0, 0), ("b", 400, 0), ("c", 0, 400), ("e", 400, 400))]
    out = {x.device: x for x in tk.track(states(spark, rows), r, zones, subs).collect()}
    assert (out["d0"].zone, out["d0"].sub_zone, out["d0"].parent_zone) == ("west", "desk", "east")
    assert (out["d1"].zone, out["d1"].sub_zone, out["d1"].parent_zone) == ("west", "unknown", "west")


def test_t12_published_numbers_round_half_to_even(spark):
    r = publish(spark.createDataFrame([(0.125, 0.375)], "raw_x double, raw_y double")).first()
    assert (r.raw_x, r.raw_y) == (0.12, 0.38)


def test_t13_corners_stored_row_by_row_have_two_orders(spark):
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 3D), named_struct('x', 4D, 'y', 3D))")
    r = spark.range(1).select(g.corner_order(ring).alias("c"), g.by_angle(ring).alias("a")).first()
    assert [tuple(p) for p in r.c] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert {tuple(p) for p in r.a} == {tuple(p) for p in r.c} and spark.range(1).select(g.area(g.by_angle(ring))).first()[0] == 12.0


def test_t14_sub_zones_keep_the_drawn_order(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (4.0, 3.0)]
    zones = spark.createDataFrame([(0, "f", 0, "z", "zone", True, False, ring)], ZONE)
    subs = spark.createDataFrame([(0, "f", 0, "s", "z", ring)], SUB)
    e = zn.prepared_subzones(subs, zones).first()["__subs"][0]
    assert [(x.ax, x.ay) for x in e["edges"]] == ring and e["parent"] == "zone"


def test_t15_bounds_of_the_self_test_take_any_vertex(spark):
    rows = [(0, "f", 0, "a", "a", True, True, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0)]), (0, "f", 1, "b", "b", True, False, [(900.0, 0.0), (0.0, 900.0)])]
    zones = spark.createDataFrame(rows, ZONE)
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0)])
    live = rd.floor_bounds(rd.readings(states(spark, [(1, "d", "a", "1")]), r), zones).first()
    assert (live.maxx, live.maxy) == (110.0, 110.0)
    assert cal.selftest_bounds(r, zones).first().maxx == 990.0


def test_t16_a_correction_counts_only_above_zero(spark):
    r = receivers(spark, [("a", 0.0, 0.0, None, 0.0), ("b", 1.0, 0.0, None, None), ("c", 2.0, 0.0, None, -2.0), ("e", 3.0, 0.0, None, 0.5)])
    got = {x.scanner: x.slant for x in rd.readings(states(spark, [(1, "d", s, "2") for s in "abce"]), r).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": 2.0, "e": 1.0}


def test_t17_and_t18_one_scale_serves_and_missing_positions_count(spark):
    rows = [("e", 1, 1.0, 0.0, 0.0, "f", "z"), ("e", 2, 2.0, None, 0.0, "f", "y"), ("e", 3, 3.0, 80.0, 0.0, "f", "z"), ("e", 4, 4.0, 0.0, 0.0, "h", "z")]
    s = spark.createDataFrame(rows, "ent string, seq int, updated double, x double, y double, floor string, zone string").withColumns({"raw_x": F.col("x"), "raw_y": F.col("y"), "rms_m": F.lit(1.0), "conf": F.lit(1.0)})
    scales = spark.createDataFrame([("f", 40.0), ("h", 10.0)], "floor string, scale double")
    out = ev.score(s, scales).filter("series = 'published'").first()
    assert (out.n, out.floor_flaps, out.zone_flaps, out.step_max, out.units) == (4, 1, 2, 2.0, "m")
    plain = ev.score(s, scales.withColumn("scale", F.lit(1.0))).first()
    assert plain.units == "px"


def test_t19_the_age_of_samples_also_decides_what_is_matched(spark):
    assert DEFAULTS.state_max_age_s == 720 * 30
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0), ("b", 1.0, 0.0, None, 1.0)])
    none = spark.createDataFrame([], "tx string, rx string")
    matched = spark.createDataFrame([("a", 1000.0), ("b", 999.0)], "slug string, matched_at double")
    got = {x.scanner: x.cause for x in cal.missing_receivers(r, none, matched, F.lit(22600.0)).collect()}
    assert got == {"a": "no_data", "b": "unmatched"}


def test_t20_floors_compare_normalised_in_calibration(spark):
    r = receivers(spark, [("a", 0.0, 0.0, None, 1.0), ("b", 40.0, 0.0, None, 1.0)]).withColumn("floor", F.when(F.col("scanner") == "a", " F ").otherwise("f"))
    assert cal.true_distances(r).count() == 2


def test_t21_and_t22_staleness_runs_from_the_last_publish():
    fresh = Track(probs={0: 1.0}, incumbent=0)
    assert step(fresh, 5000, {0: (1, 1.0, 1.0, 0.1, 0.9, 40.0, 0, 0, 9, 9)})[0] == 0 and fresh.updated == 5000
    heard = Track(probs={0: 0.9, 1: 0.1}, incumbent=0, updated=1.0, dark=1)
    fix = step(heard, 400, {1: (1, 1.0, 1.0, 0.1, 0.9, 40.0, 0, 0, 9, 9)})
    assert fix[0] == 1 and heard.probs == {1: 1.0}
