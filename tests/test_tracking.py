import pytest
from pyspark.sql import functions as F

from spatiotrack.functions import scalars as f
from spatiotrack.operators import tracking as tk
from spatiotrack.operators import zones as zn
from spatiotrack.operators.snapping import Region, snap_into_zones
from spatiotrack.sources import fixtures as fx
from spatiotrack.operators.tracking import Track, elect, smooth


def test_switch_needs_three_cycles_with_a_lead():
    t = Track()
    assert elect(t, {0: 0.9, 1: 0.3}) == 0
    got = [elect(t, {0: 0.1, 1: 0.9}) for _ in range(6)]
    assert got[-1] == 1 and got.index(1) >= 2


def test_small_lead_resets_the_count():
    t = Track({0: 0.5, 1: 0.5}, 0, 1, 2)
    assert elect(t, {0: 0.51, 1: 0.5}) == 0 and t.rival_count == 0


def test_dark_floor_holds_three_cycles():
    t = Track()
    elect(t, {0: 0.9, 1: 0.2})
    assert [elect(t, {1: 0.9}) for _ in range(4)] == [None, None, None, 1]


def test_removed_floor_resets_the_election():
    t = Track({7: 1.0}, 7)
    assert elect(t, {0: 0.4}, valid={0, 1}) == 0 and t.probs == {0: 1.0}


def test_probabilities_add_up_to_one():
    t = Track()
    for k in range(20):
        elect(t, {0: 0.5 + k % 3 / 10, 1: 0.4, 2: 0.2})
    assert sum(t.probs.values()) == pytest.approx(1)


def test_filter_starts_at_the_fix_and_resets():
    t = Track()
    assert smooth(t, 0, 0.0, 10.0, 20.0, 40.0) == (10.0, 20.0)
    assert smooth(t, 0, 30.0, 50.0, 20.0, 40.0) != (50.0, 20.0)
    assert smooth(t, 0, 60.1, 90.0, 20.0, 40.0) == (90.0, 20.0)
    assert smooth(t, 1, 61.0, 5.0, 5.0, 40.0) == (5.0, 5.0)


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_guards_against_nan_and_limits(spark):
    h = lambda x: value(spark, f.tracker_height(F.lit(x).cast("double")))
    assert [h(float("nan")), h(None), h(5.0), h(5.1), h(-0.1)] == [1.0, 1.0, 5.0, 1.0, 1.0]
    flat = lambda height: value(spark, f.horizontal(F.lit(5.0), F.lit(height).cast("double"), F.lit(1.0)))
    assert flat(4.0) == 4.0 and flat(float("nan")) == 5.0 and flat(10.1) == 5.0 and flat(None) == 5.0
    assert value(spark, f.corrected(F.lit(2.0), F.lit(float("nan")))) == 2.0
    assert value(spark, f.corrected(F.lit(2.0), F.lit(-1.0))) == 2.0
    assert value(spark, f.number(F.lit(" 2.5 "))) == 2.5 and value(spark, f.number(F.lit("unknown"))) is None


def test_jump_weight_is_blind_below_the_least_radius(spark):
    w = lambda r, p: value(spark, f.jump_weight(F.lit(r).cast("double"), F.lit(p).cast("double"), F.lit(20.0)))
    assert w(0.0, 16.0) == 1.0 and w(30.0, None) == 1.0 and w(60.0, 20.0) < 0.1


def points(spark, rows):
    return spark.createDataFrame(rows, "floor_seq int, id int, x double, y double")


def test_zone_edges_and_buffers(spark):
    rows = [(1, 0, 900.0, 500.0), (1, 1, 920.0, 500.0), (1, 2, 1300.0, 600.0), (1, 3, 1301.0, 600.0), (1, 4, 5000.0, 5000.0)]
    got = {r.id: r for r in zn.locate(points(spark, rows), fx.zones(spark)).collect()}
    assert got[0].zone == "west" and got[1].zone == "west" and got[4].zone == "unknown" and got[4].nearest_zone == "east"
    assert not got[2].no_go and got[3].no_go


def test_snap_leaves_the_forbidden_zone(spark):
    rows = [(1, 0, 1310.0, 600.0), (1, 1, 100.0, 100.0), (1, 2, 500.0, 500.0), (0, 3, 925.0, 700.0), (9, 4, 1.0, 2.0)]
    got = {r.id: (r.x, r.y) for r in snap_into_zones(points(spark, rows), fx.zones(spark)).collect()}
    assert got[0] == pytest.approx((1297.0, 600.0)) and got[1] == pytest.approx((200.0, 200.0))
    assert got[2] == (500.0, 500.0) and got[3] in ((900.0, 700.0), (950.0, 700.0)) and got[4] == (1.0, 2.0)


def test_only_forbidden_zones_push_off():
    import numpy as np

    ring = np.array([[0, 0, 10, 0], [10, 0, 10, 10], [10, 10, 0, 10], [0, 10, 0, 0]], float)
    out = Region([], [ring], 3.0).snap(np.array([[9.0, 5.0], [20.0, 5.0]]))
    assert out[0] == pytest.approx((13.0, 5.0)) and out[1] == pytest.approx((20.0, 5.0))


def test_stream_equals_batch(spark, sf):
    from spatiotrack.plans.tracking import live_fixes, tracking

    batch, stream = tracking(spark, sf), tk.publish(live_fixes(spark, sf))
    a, b = {(r.device, r.tick): r for r in batch.collect()}, {(r.device, r.tick): r for r in stream.collect()}
    assert a.keys() == b.keys() and a
    for k, want in a.items():
        for c in batch.columns:
            assert want[c] == b[k][c] if not isinstance(want[c], float) else want[c] == pytest.approx(b[k][c], abs=2e-3), (k, c)


def test_tracking_finds_most_devices(spark, sf):
    from spatiotrack.plans.tracking import tracking

    out = tracking(spark, sf).join(fx.truth(spark, sf).select(F.concat(F.lit("dev"), "device").alias("device"), "tick", "true_floor"), ["device", "tick"])
    right, n = out.agg(F.count_if(F.col("floor_seq") == F.col("true_floor")), F.count(F.lit(1))).first()
    assert right / n > 0.9


def test_pieces_of_a_history_fold_like_the_whole(spark):
    import math

    from spatiotrack.operators import readings as rd

    # Gaps of 299 to 302 seconds and of hours, inside and across blocks, in two devices; a third has none.
    rows, corners = [], [(0.0, 0.0), (800.0, 0.0), (0.0, 800.0)]
    for device, gaps in (("a", [299, 300, 301, 302, 5000, 1]), ("b", [301, 301, 40000]), ("c", [300, 2])):
        tick = 0
        for k in range(60):
            tick += gaps[(k // 8) % len(gaps)] if k % 8 == 7 else 1
            for floor in (0, 1):
                for i, (x, y) in enumerate(corners):
                    r = math.hypot(x - 300 - 5 * k % 200, y - 200 - 40 * floor * (k % 5)) * (1 + 0.2 * ((k * 7 + i + floor) % 3))
                    rows.append((device, tick, floor, f"f{floor}", i, x, y, r, r / 40 + floor, 40.0))
    df = spark.createDataFrame(rows, "device string, tick int, floor_seq int, floor string, rec_seq int, x double, y double, r double, slant double, scale double")
    zones = fx.zones(spark)
    cut = rd.with_pieces(df)
    assert {r.device: r.n for r in cut.groupBy("device").agg(F.max("piece").alias("n")).collect()} == {"a": 3, "b": 7, "c": 0}
    key = lambda r: (r.device, r.tick)
    whole = {key(r): r for r in tk.fold_fixes(tk.hypotheses(df, zones)).collect()}
    pieces = {key(r): r for r in tk.fold_fixes(tk.hypotheses(cut, zones)).collect()}
    assert whole.keys() == pieces.keys() and len(whole) == 180
    assert all(whole[k].asDict() == pieces[k].asDict() for k in whole)


def test_one_long_history_is_spread_over_tasks(spark):
    from spatiotrack.operators import readings as rd

    # A day of seconds in stretches of five minutes, six minutes apart.
    ticks = spark.range(0, 86_400).selectExpr("'d' AS device", "cast(id + (id div 300) * 360 AS int) AS tick")
    cut = rd.with_pieces(ticks)
    assert cut.select("piece").distinct().count() == 288
    sizes = [r.n for r in cut.repartition(8, "device", "piece").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 86_400 / 4


def test_methods_of_the_readings_chain_are_short_enough_to_be_compiled(spark, sf):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    import re

    from spatiotrack.plans import tracking as tr

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (tr.p3_corrected, tr.a1_candidate_floors, tr.nearest_floor, tr.p20_fit_score):
            plan = query(spark, sf)._jdf.queryExecution()
            shown = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
            assert sizes and max(sizes) < 8000, (query.__name__, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_more_events_make_more_tasks_and_states_do_not_meet_ticks_by_shuffle(spark, sf, monkeypatch):
    from spatiotrack.operators import readings as rd
    from spatiotrack.sources import fixtures as fx

    few = fx.tasks(spark, sf)
    monkeypatch.setattr(fx, "EVENTS_A_TASK", 50)
    assert fx.tasks(spark, sf) == 20 > few and fx.truth(spark, sf).rdd.getNumPartitions() == 20
    states = fx.sensor_states(spark, sf)
    shown = rd.enough_sensors(states, tasks=20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and "hashpartitioning(tick" in shown and ", 20), REPARTITION_BY_NUM" in shown


def test_fit_scores_and_recordings_are_dealt_out_by_the_number_of_events(spark, sf, monkeypatch):
    from spatiotrack.plans import evaluation as evl
    from spatiotrack.plans import tracking as tr
    from spatiotrack.sources import fixtures as fx

    monkeypatch.setattr(fx, "EVENTS_A_TASK", 50)
    for query, by in ((tr.p21_no_go_penalty, "hashpartitioning(device"), (evl.score_recording, "hashpartitioning(ent")):
        shown = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in shown.splitlines() if by in line]
        assert dealt and all(", 20), REPARTITION_BY_NUM" in line for line in dealt), dealt


def test_the_foot_on_a_side_is_worked_out_once_for_each_zone(spark, sf):
    """Spark works out a lambda's expression at each place where it stands: the share of the side at which the foot lies stands there once."""
    from pyspark.sql import functions as F

    from spatiotrack.functions import geometry as g
    from spatiotrack.plans import tracking as tr

    def feet(df):
        return df._jdf.queryExecution().analyzed().toString().count("greatest(")

    assert feet(tr.g2_containment(spark, sf)) == 1
    ring = F.expr("array(named_struct('ax', 0D, 'ay', 0D, 'bx', 4D, 'by', 0D), named_struct('ax', 4D, 'ay', 0D, 'bx', 4D, 'by', 0D))")
    at = spark.range(1).select(g.nearest_on_edges(F.lit(1.0), F.lit(3.0), ring).alias("p"), g.boundary_distance(F.lit(7.0), F.lit(4.0), ring).alias("d"))
    assert feet(at) == 2
    row = at.first()
    assert tuple(row["p"]) == (3.0, 1.0, 0.0) and row["d"] == 5.0


def test_the_chain_is_dealt_out_by_the_number_of_events(spark, sf, monkeypatch):
    from spatiotrack.plans import tracking as tr
    from spatiotrack.sources import fixtures as fx

    monkeypatch.setattr(fx, "EVENTS_A_TASK", 50)
    for query, n in ((tr.m1_trilaterate, 1), (tr.st_published_fixes, 2), (tr.tracking, 2)):
        shown = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in shown.splitlines() if "hashpartitioning(device" in line]
        assert len(dealt) == n and all(", 20), REPARTITION_BY_NUM" in line for line in dealt), dealt


def test_entity_ids_are_cut_without_patterns(spark):
    ids = ["sensor.dev1_distance_to_rx3", "sensor.a_distance_to_b_distance_to_c", "sensor.sensor.x_distance_to_y", "x_distance_to_", "_distance_to_z", "größe.sensor.ä_distance_to_ö", "a\nsensor.b_distance_to_c\nd", "sensorx_distance_to_y", "sensor.plain", None]
    df = spark.createDataFrame([(i,) for i in ids], "e string").select("e", f.device_of(F.col("e")).alias("d"), f.scanner_of(F.col("e")).alias("s"))
    want = [("dev1", "rx3"), ("a", "b_distance_to_c"), ("sensor.x", "y"), ("x", ""), ("", "z"), ("größe.sensor.ä", "ö"), ("a\nsensor.b", "c\nd"), ("sensorx", "y"), ("plain", None), (None, None)]
    assert [(r.d, r.s) for r in df.collect()] == want
    shown = df._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in shown and "split" not in shown


def test_zones_are_measured_only_where_their_box_holds_the_point(spark):
    """On borders, corners and off all zones: the same as measured against every zone."""
    from spatiotrack.functions import geometry as g

    spots = [(x, y) for x in (150.0, 200.0, 500.0, 900.0, 925.0, 950.0, 1300.0, 1400.0, 1401.0, 1800.0, 1900.0) for y in (100.0, 200.0, 500.0, 700.0, 700.5, 1200.0, 1300.0)]
    rows = points(spark, [(k, i, *p) for k in range(4) for i, p in enumerate(spots)])
    prepared = zn.prepared_zones(fx.zones(spark))
    x, y = F.col("x"), F.col("y")
    every = F.array_min(F.transform(zn.allowed(F.col("zones")), lambda z: F.struct(g.distance(x, y, z["edges"]).alias("d"), z["zone_seq"].alias("k"), z["zone"].alias("zone"))))["zone"]
    out = rows.join(prepared, "floor_seq").select(zn.nearest_zone(x, y, F.col("zones")).alias("got"), F.coalesce(every, F.lit("unknown")).alias("want")).collect()
    assert len(out) == 3 * len(spots) and all(r.got == r.want for r in out)
    snapped = rows.join(prepared, "floor_seq").select(zn.snap_plain(x, y, F.col("zones")).alias("p"))
    shown = snapped._jdf.queryExecution().analyzed().toString()
    assert shown.count(".box") >= 4
