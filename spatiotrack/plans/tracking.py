"""Queries of the tracking chain: sources, ranges, candidates, weights, zones, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as f
from ..operators import readings as rd
from ..operators import tracking as tk
from ..operators import zones as zn
from ..sources import fixtures as fx
from .common import EDGES, READINGS, RECEIVERS, RECORDING, ROOM_EDGES, STATES, SUB_EDGES, SUPPLIED, TRUTH, WEIGHTED, point_zones, solved, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sensor_states(spark, sf)


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return rd.readings(_states(spark, sf), fx.receivers(spark))


REGISTRY = "reg AS (SELECT 'sensor.dev' || user_id || '_distance_to_rx' || r AS entity_id, CASE WHEN r = 11 AND user_id % 7 = 0 THEN 'template' ELSE 'bermuda' END AS platform FROM (SELECT DISTINCT user_id FROM events), range(12) AS t(r))"


@query(sql(STATES + "," + REGISTRY, "SELECT st.entity_id, count(*) AS n_states FROM st WHERE st.entity_id LIKE '%\\_distance\\_to\\_%' ESCAPE '\\' AND entity_id IN (SELECT entity_id FROM reg WHERE platform = 'bermuda') GROUP BY 1"))
def s1_owned_sensors(spark, sf):
    own = rd.owned_sensors(_states(spark, sf), fx.registry(spark, sf))
    return own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_states"))


@query(sql(STATES, "SELECT DISTINCT entity_id FROM st WHERE regexp_matches(entity_id, '^sensor\\..+_distance_to_.+$')"))
def s2_distinct_sensors(spark, sf):
    return _states(spark, sf).filter(F.col("entity_id").rlike(r"^sensor\..+_distance_to_.+$")).select("entity_id").distinct()


@query(sql(STATES, "SELECT regexp_replace(split_part(entity_id, '_distance_to_', 1), '^sensor\\.', '') AS device, split_part(entity_id, '_distance_to_', 2) AS scanner, count(*) AS n FROM st GROUP BY ALL"))
def s3_split_entity(spark, sf):
    s = _states(spark, sf).select(f.device_of(F.col("entity_id")).alias("device"), f.scanner_of(F.col("entity_id")).alias("scanner"))
    return s.groupBy("device", "scanner").agg(F.count(F.lit(1)).alias("n"))


@query(sql(STATES + ", n AS (SELECT tick FROM st GROUP BY tick HAVING count(DISTINCT entity_id) >= 3)", "SELECT tick, count(*) AS n_states FROM st WHERE tick IN (SELECT tick FROM n) GROUP BY tick"))
def st1_sensor_gate(spark, sf):
    return rd.enough_sensors(_states(spark, sf), tasks=fx.tasks(spark, sf)).groupBy("tick").agg(F.count(F.lit(1)).alias("n_states"))


@query(sql(STATES, "SELECT event_id, entity_id, try_cast(state AS DOUBLE) AS value FROM st WHERE try_cast(state AS DOUBLE) IS NOT NULL"))
def p1_parse_reading(spark, sf):
    return _states(spark, sf).select("event_id", "entity_id", f.number(F.col("state")).alias("value")).filter("value is not null")


@query(sql(READINGS, "SELECT event_id, scanner, round(metres, 6) AS metres FROM par WHERE metres IS NOT NULL"))
def p2_metres(spark, sf):
    s = _states(spark, sf).select("event_id", f.scanner_of(F.col("entity_id")).alias("scanner"), F.round(f.metres(f.number(F.col("state")), F.col("unit")), 6).alias("metres"))
    return s.filter("metres is not null")


@query(sql(READINGS, "SELECT event_id, scanner, round(slant, 6) AS slant FROM sl"))
def p3_corrected(spark, sf):
    return _readings(spark, sf).select("event_id", "scanner", F.round("slant", 6).alias("slant"))


@query(sql("v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE (event_id % 80) / 10e0 - 1 END AS h FROM events)", "SELECT event_id, CASE WHEN h IS NOT NULL AND NOT isnan(h) AND h BETWEEN 0 AND 5 THEN h ELSE 1e0 END AS tracker_height FROM v"))
def p4_tracker_height(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id")
    h = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 80) / 10.0 - 1)
    return e.select("event_id", f.tracker_height(h).alias("tracker_height"))


@query(sql(READINGS, "SELECT event_id, scanner, round(horizontal, 6) AS horizontal FROM rd"))
def p5_horizontal(spark, sf):
    return _readings(spark, sf).select("event_id", "scanner", F.round("horizontal", 6).alias("horizontal"))


@query(sql(READINGS, "SELECT event_id, device, scanner, floor, round(r, 5) AS r, round(slant, 6) AS slant FROM rr"))
def j1_radius(spark, sf):
    return _readings(spark, sf).select("event_id", "device", "scanner", "floor", F.round("r", 5).alias("r"), F.round("slant", 6).alias("slant"))


@query(sql(STATES + "," + REGISTRY, "SELECT count(*) AS n, count(DISTINCT entity_id) AS sensors FROM st WHERE EXISTS (SELECT 1 FROM reg WHERE reg.entity_id = st.entity_id AND platform = 'bermuda')"))
def j3_ownership(spark, sf):
    return rd.owned_sensors(_states(spark, sf), fx.registry(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("sensors"))


@query(sql(READINGS, "SELECT device, tick, floor, round(min(slant), 6) AS nearest_m, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(rec_seq AS VARCHAR), ',' ORDER BY rec_seq) AS heard_by FROM rr GROUP BY device, tick, floor"))
def a1_candidate_floors(spark, sf):
    c = rd.candidate_floors(_readings(spark, sf))
    return c.select("device", "tick", "floor", F.round("nearest_m", 6).alias("nearest_m"), "n", F.array_join(F.transform("points", lambda p: p["rec_seq"].cast("string")), ",").alias("heard_by"))


@query(sql(READINGS + ", c AS (SELECT device, tick, floor_seq, floor, min(slant) AS nearest_m, count(*) AS n FROM rr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY device, tick ORDER BY nearest_m, floor_seq) AS rank FROM c WHERE n >= 3)", "SELECT device, tick, floor, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"))
def w2_rank_floors(spark, sf):
    return rd.rank_floors(rd.candidate_floors(_readings(spark, sf))).select("device", "tick", "floor", "rank")


@query(sql(READINGS + ", c AS (SELECT device, tick, floor_seq, floor, min(slant) AS nearest_m FROM rr GROUP BY ALL)", "SELECT device, tick, arg_min(floor, struct_pack(a := nearest_m, b := floor_seq)) AS nearest_floor FROM c GROUP BY device, tick"))
def nearest_floor(spark, sf):
    c = rd.candidate_floors(_readings(spark, sf))
    return c.groupBy("device", "tick").agg(F.min_by("floor", F.struct("nearest_m", "floor_seq")).alias("nearest_floor"))


@query(sql(WEIGHTED, "SELECT event_id, scanner, CAST(cycle AS INTEGER) AS cycle, round(previous_r, 5) AS previous_r FROM wt"))
def w1_previous_radius(spark, sf):
    return rd.with_jump_weights(_readings(spark, sf)).select("event_id", "scanner", "cycle", F.round("previous_r", 5).alias("previous_r"))


@query(sql(WEIGHTED, "SELECT event_id, scanner, round(w, 6) AS w FROM wt"))
def p16_jump_weight(spark, sf):
    return rd.with_jump_weights(_readings(spark, sf)).select("event_id", "scanner", F.round("w", 6).alias("w"))


@query(sql("v AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE (event_id % 400) / 4e0 END AS scale FROM events)", "SELECT event_id, CASE WHEN scale <> 0 THEN scale * 0.5e0 ELSE 1e-3 END AS min_radius FROM v"))
def p17_min_weight_radius(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, 0.0).otherwise((F.col("event_id") % 400) / 4.0).alias("scale"))
    return e.select("event_id", f.min_weight_radius(F.col("scale")).alias("min_radius"))


@query(sql(READINGS + "," + EDGES + ", zb AS (SELECT floor_seq, min(ax) AS zx0, min(ay) AS zy0, max(ax) AS zx1, max(ay) AS zy1 FROM zed GROUP BY 1), u AS (SELECT device, tick, floor_seq, least(min(x), min(zx0)) AS x0, least(min(y), min(zy0)) AS y0, greatest(max(x), max(zx1)) AS x1, greatest(max(y), max(zy1)) AS y1 FROM rr JOIN zb USING (floor_seq) GROUP BY ALL), m AS (SELECT *, 0.1e0 * greatest(x1 - x0, y1 - y0, 1e0) AS m FROM u)", "SELECT device, tick, floor_seq, x0 - m AS minx, y0 - m AS miny, x1 + m AS maxx, y1 + m AS maxy FROM m"))
def p18_solver_bounds(spark, sf):
    return rd.floor_bounds(_readings(spark, sf), fx.zones(spark)).select("device", "tick", "floor_seq", "minx", "miny", "maxx", "maxy")


@query(sql(SUPPLIED + "," + ROOM_EDGES + ", v AS (SELECT floor_seq, x, y FROM rec UNION ALL SELECT floor_seq, ax, ay FROM red), b AS (SELECT floor_seq, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY 1)", "SELECT floor_seq, x0 - 0.1e0 * greatest(x1 - x0, y1 - y0, 1e0) AS minx, y0 - 0.1e0 * greatest(x1 - x0, y1 - y0, 1e0) AS miny, x1 + 0.1e0 * greatest(x1 - x0, y1 - y0, 1e0) AS maxx, y1 + 0.1e0 * greatest(x1 - x0, y1 - y0, 1e0) AS maxy FROM b"))
def p19_selftest_bounds(spark, sf):
    from ..operators.calibration import selftest_bounds

    return selftest_bounds(fx.supplied(spark, sf), fx.rooms(spark, sf))


FIT = WEIGHTED + "," + "fixes AS (SELECT 'dev' || device AS device, tick, CAST(true_x + (event_id * 37) % 401 - 200 AS DOUBLE) AS fx, CAST(true_y + (event_id * 53) % 301 - 150 AS DOUBLE) AS fy FROM tr), fit AS (SELECT device, tick, floor_seq, fx, fy, count(*) AS n, sqrt(sum(w * pow(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) - r, 2)) / sum(w)) * sqrt(count(*) / greatest(count(*) - 2e0, 1e0)) / 40e0 AS rms_m FROM wt JOIN fixes USING (device, tick) GROUP BY ALL), sc AS (SELECT *, least(1e0, n / 5e0) AS coverage FROM fit), cf AS (SELECT *, 0.5e0 * coverage + 0.5e0 / (1 + (rms_m / 2) * (rms_m / 2)) AS conf FROM sc)"


def _scores(spark, sf):
    rec = fx.recording(spark, sf).select(F.col("ent").alias("device"), "tick", F.col("x").alias("fx"), F.col("y").alias("fy"))
    fixes = rec.join(fx.receivers(spark).select("floor_seq").distinct().hint("broadcast"), how="cross")
    # As many tasks as the readings' making has: windows by device need no other shuffle, nor do the join and the sums by key.
    n, keys = fx.tasks(spark, sf), ["device", "tick", "floor_seq"]
    points = rd.with_jump_weights(_readings(spark, sf).repartition(n, "device"))
    return rd.fit_score(points.repartition(n, *keys), fixes.repartition(n, *keys))


@query(sql(FIT, "SELECT device, tick, floor_seq, round(rms_m, 5) AS rms_m, coverage, round(conf, 5) AS conf FROM cf"))
def p20_fit_score(spark, sf):
    return _scores(spark, sf).select("device", "tick", "floor_seq", F.round("rms_m", 5).alias("rms_m"), "coverage", F.round("conf", 5).alias("conf"))


@query(sql(FIT + "," + EDGES + ", pts AS (SELECT device || '/' || tick || '/' || floor_seq AS id, floor_seq, fx AS px, fy AS py FROM cf)," + point_zones("pts") + ", dead AS (SELECT id FROM pz WHERE no_go AND odd AND d > 1e-9)", "SELECT device, tick, floor_seq, round(conf * (CASE WHEN device || '/' || tick || '/' || floor_seq IN (SELECT id FROM dead) THEN 0.15e0 ELSE 1e0 END), 5) AS conf FROM cf"))
def p21_no_go_penalty(spark, sf):
    s = _scores(spark, sf)
    j = s.join(zn.small(zn.prepared_zones(fx.zones(spark))), "floor_seq", "left")
    dead = zn.in_no_go(F.col("fx"), F.col("fy"), F.col("zones"))
    return j.select("device", "tick", "floor_seq", F.round(F.col("conf") * F.when(dead, 0.15).otherwise(1.0), 5).alias("conf"))


# Spatial lookups, over recorded fixes.
PTS = RECORDING + "," + EDGES + ", pts AS (SELECT event_id AS id, floor_seq, x AS px, y AS py FROM rc)," + point_zones("pts")


def _located(spark, sf):
    return zn.locate(fx.recording(spark, sf).drop("zone").select("event_id", "floor_seq", "x", "y"), fx.zones(spark))


@query(sql(PTS + ", hit AS (SELECT id, arg_min(zone, zone_seq) AS zone FROM pz WHERE NOT no_go AND (odd OR d <= 1e-9) GROUP BY 1), soft AS (SELECT id, arg_min(zone, struct_pack(a := d, b := zone)) AS zone FROM pz WHERE NOT no_go AND d < buffer GROUP BY 1)", "SELECT pts.id AS event_id, coalesce(hit.zone, soft.zone, 'unknown') AS zone FROM pts LEFT JOIN hit USING (id) LEFT JOIN soft USING (id)"))
def j12_zone_at_point(spark, sf):
    return _located(spark, sf).select("event_id", "zone")


@query(sql(PTS + ", hit AS (SELECT DISTINCT id FROM pz WHERE NOT no_go AND (odd OR d <= 1e-9)), soft AS (SELECT id, min(struct_pack(a := d, b := zone)) AS m FROM pz WHERE NOT no_go AND d < buffer AND id NOT IN (SELECT id FROM hit) GROUP BY 1)", "SELECT id AS event_id, m.b AS zone, round(m.a, 6) AS distance FROM soft"))
def j13_soft_zone(spark, sf):
    r = fx.recording(spark, sf).select("event_id", "floor_seq", "x", "y").join(zn.small(zn.prepared_zones(fx.zones(spark))), "floor_seq")
    x, y = F.col("x"), F.col("y")
    near = F.filter(zn.allowed(F.col("zones")), lambda z: g.boundary_distance(x, y, z["edges"]) < z["buffer"])
    best = F.array_min(F.transform(near, lambda z: F.struct(g.boundary_distance(x, y, z["edges"]).alias("d"), z["zone"].alias("zone"))))
    hit = F.exists(zn.allowed(F.col("zones")), lambda z: g.covers(x, y, z["edges"]))
    return r.filter(~hit).select("event_id", best.alias("b")).filter("b is not null").select("event_id", F.col("b.zone").alias("zone"), F.round("b.d", 6).alias("distance"))


@query(sql(PTS, "SELECT id AS event_id, arg_min(zone, struct_pack(a := CASE WHEN odd THEN 0e0 ELSE d END, b := zone_seq)) AS nearest_zone FROM pz WHERE NOT no_go GROUP BY 1"))
def j14_nearest_zone(spark, sf):
    return _located(spark, sf).select("event_id", "nearest_zone")


@query(sql(RECORDING + "," + SUB_EDGES + ", pts AS (SELECT event_id AS id, floor_seq, x AS px, y AS py FROM rc)," + point_zones("pts", "sed", "sub_seq, sub_zone, parent") + ", hit AS (SELECT id, arg_min(sub_zone, sub_seq) AS sub_zone, arg_min(parent, sub_seq) AS parent FROM pz WHERE odd OR d <= 1e-9 GROUP BY 1)", "SELECT pts.id AS event_id, coalesce(hit.sub_zone, 'unknown') AS sub_zone, hit.parent AS sub_parent FROM pts LEFT JOIN hit USING (id)"))
def j15_subzone_at_point(spark, sf):
    return zn.locate_subzone(fx.recording(spark, sf).select("event_id", "floor_seq", "x", "y"), fx.subzones(spark), fx.zones(spark)).select("event_id", "sub_zone", "sub_parent")


@query(sql(PTS, "SELECT DISTINCT id AS event_id FROM pz WHERE no_go AND odd AND d > 1e-9"))
def j16_no_go(spark, sf):
    return _located(spark, sf).filter("no_go").select("event_id")


@query(sql(SUPPLIED + "," + ROOM_EDGES + ", pts AS (SELECT scanner AS id, floor_seq, x AS px, y AS py FROM rec)," + point_zones("pts", "red") + ", hit AS (SELECT id, arg_min(zone, zone_seq) AS zone FROM pz WHERE odd GROUP BY 1)", "SELECT scanner, coalesce(zone, '__unzoned__::' || floor) AS zone_group FROM rec LEFT JOIN hit ON id = scanner"))
def j17_receiver_groups(spark, sf):
    return zn.group_receivers(fx.supplied(spark, sf), fx.rooms(spark, sf)).select("scanner", "zone_group")


@query(sql(PTS + ", near AS (SELECT id, px, py, floor_seq, bool_or(odd OR d <= 1e-9) AS covered FROM pz WHERE NOT no_go GROUP BY ALL), cand AS (SELECT id, px, py, greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) AS t, ax, ay, bx, bz FROM near JOIN zed USING (floor_seq) WHERE NOT covered AND NOT zed.no_go), q AS (SELECT id, ax + t * (bx - ax) AS qx, ay + t * (bz - ay) AS qy, px, py FROM cand), best AS (SELECT id, arg_min(qx, struct_pack(a := sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), b := qx, c := qy)) AS qx, arg_min(qy, struct_pack(a := sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), b := qx, c := qy)) AS qy FROM q GROUP BY 1)", "SELECT near.id AS event_id, round(coalesce(qx, px), 5) AS x, round(coalesce(qy, py), 5) AS y FROM near LEFT JOIN best USING (id) WHERE floor_seq <> 1"))
def g4_snap(spark, sf):
    from ..operators.snapping import snap_into_zones

    points = fx.recording(spark, sf).filter("floor_seq <> 1").select("event_id", "floor_seq", "x", "y")
    return snap_into_zones(points, fx.zones(spark)).select("event_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def g4_snap_no_go(spark, sf):
    from ..operators.snapping import snap_into_zones

    points = fx.recording(spark, sf).filter("floor_seq = 1").select("event_id", "floor_seq", "x", "y")
    return snap_into_zones(points, fx.zones(spark)).select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# On the floor with a forbidden square, which lies well inside the east zone: the nearest valid point of
# the west zone is its clamp; of the east zone the clamp, or the way out of the square grown by three.
MOVED = RECORDING + """,
p AS (SELECT event_id, x, y, greatest(200e0, least(900e0, x)) AS wx, greatest(200e0, least(1200e0, y)) AS wy, greatest(950e0, least(1800e0, x)) AS ex, greatest(200e0, least(1200e0, y)) AS ey, greatest(1300e0, least(1600e0, x)) AS vx, greatest(500e0, least(800e0, y)) AS vy FROM rc WHERE floor_seq = 1),
q AS (SELECT *, sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) AS west, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS east, sqrt((x - vx) * (x - vx) + (y - vy) * (y - vy)) AS near FROM p),
r AS (SELECT event_id, least(west, CASE WHEN east > 0 OR near >= 3 THEN east WHEN near > 0 THEN 3 - near ELSE least(x - 1297, 1603 - x, y - 497, 803 - y) END) AS moved FROM q)"""


@query(sql(MOVED, "SELECT event_id, round(moved, 4) AS moved, true AS valid FROM r"))
def g4_snap_no_go_moved(spark, sf):
    """How far points move on a floor with a forbidden zone, and that they end where they may be."""
    from ..operators.snapping import snap_into_zones

    points = fx.recording(spark, sf).filter("floor_seq = 1").select("event_id", "floor_seq", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"))
    out = snap_into_zones(points, fx.zones(spark)).join(zn.small(zn.prepared_zones(fx.zones(spark))), "floor_seq")
    x, y = F.col("x"), F.col("y")
    inside = F.exists("zones", lambda z: ~z["no_go"] & (g.distance(x, y, z["edges"]) <= 1e-6))
    clear = F.forall("zones", lambda z: ~z["no_go"] | (g.distance(x, y, z["edges"]) >= 3 - 1e-6))
    return out.select("event_id", F.round(F.sqrt((x - F.col("x0")) ** 2 + (y - F.col("y0")) ** 2), 4).alias("moved"), (inside & clear).alias("valid"))


@query(sql(ROOM_EDGES, "SELECT floor_seq, zone_seq, zone, round(abs(sum(ax * bz - bx * ay)) / 2, 6) AS area, min(ax) AS minx, min(ay) AS miny, max(ax) AS maxx, max(ay) AS maxy, round(0.05e0 * (max(ax) - min(ax) + max(ay) - min(ay)) / 2, 6) AS buffer FROM red GROUP BY ALL"))
def g1_zone_shapes(spark, sf):
    z = fx.rooms(spark, sf)
    ring = F.when(~F.col("poly") & (F.size("ring") == 4), g.by_angle(F.col("ring"))).otherwise(F.col("ring"))
    b = g.bounds(F.col("ring"))
    return z.withColumn("ring", ring).select("floor_seq", "zone_seq", "zone", F.round(g.area(F.col("ring")), 6).alias("area"), b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"), F.round((b["maxx"] - b["minx"] + b["maxy"] - b["miny"]) / 2 * 0.05, 6).alias("buffer"))


@query(sql(PTS, "SELECT id AS event_id, zone_seq, odd AS inside, odd OR d <= 1e-9 AS covers, round(d, 6) AS boundary FROM pz"))
def g2_containment(spark, sf):
    r = fx.recording(spark, sf).select("event_id", "floor_seq", "x", "y").join(zn.small(zn.prepared_zones(fx.zones(spark))), "floor_seq")
    x, y = F.col("x"), F.col("y")
    told = F.transform("zones", lambda z: F.struct(z["zone_seq"].alias("zone_seq"), g.inside(x, y, z["edges"]).alias("inside"), g.boundary_distance(x, y, z["edges"]).alias("d")))
    rows = F.transform(told, lambda z: F.struct(z["zone_seq"].alias("zone_seq"), z["inside"].alias("inside"), (z["inside"] | (z["d"] <= g.TOUCH)).alias("covers"), F.round(z["d"], 6).alias("boundary")))
    return r.select("event_id", F.inline(rows))


@query(sql(RECORDING, "SELECT event_id, round(sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), 6) AS d FROM (SELECT event_id, x AS px, y AS py, 200e0 + greatest(0e0, least(1e0, ((x - 200) * 1600e0 + (y - 200) * 1000e0) / 3560000e0)) * 1600e0 AS qx, 200e0 + greatest(0e0, least(1e0, ((x - 200) * 1600e0 + (y - 200) * 1000e0) / 3560000e0)) * 1000e0 AS qy FROM rc)"))
def g6_segment_distance(spark, sf):
    e = F.struct(F.lit(200.0).alias("ax"), F.lit(200.0).alias("ay"), F.lit(1800.0).alias("bx"), F.lit(1200.0).alias("by"))
    r = fx.recording(spark, sf).withColumn("e", e)
    return r.select("event_id", F.round(g.segment_distance(F.col("x"), F.col("y"), F.col("e")), 6).alias("d"))


# Folds.
SCORES = TRUTH + ", fl AS (SELECT 'dev' || device AS device, tick, k AS floor_seq, CAST(((event_id * 7 + k * 13 + (CASE WHEN k = (true_floor + tick // 9) % 3 THEN 40 ELSE 0 END)) % 97 + 3) AS DOUBLE) / 100 AS conf FROM tr, range(3) AS t(k) WHERE (event_id + k * 5) % 4 <> 0)"


def _fold_scores(spark, sf):
    """Confidence of up to three floors per device and tick."""
    t = fx.truth(spark, sf).join(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("floor_seq"))), how="cross")
    e, k = F.col("event_id"), F.col("floor_seq")
    bonus = F.when(k == (F.col("true_floor") + F.expr("tick div 9")) % 3, 40).otherwise(0)
    conf = ((e * 7 + k * 13 + bonus) % 97 + 3).cast("double") / 100
    return t.filter((e + k * 5) % 4 != 0).select(F.concat(F.lit("dev"), "device").alias("device"), "tick", k, conf.alias("conf"))


ELECTION = """
piv AS (SELECT device, tick, max(conf) FILTER (floor_seq = 0) AS c0, max(conf) FILTER (floor_seq = 1) AS c1, max(conf) FILTER (floor_seq = 2) AS c2, row_number() OVER (PARTITION BY device ORDER BY tick) AS n FROM fl GROUP BY device, tick),
f AS (
  SELECT device, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS tick, CAST(NULL AS DOUBLE) AS p0, CAST(NULL AS DOUBLE) AS p1, CAST(NULL AS DOUBLE) AS p2, CAST(NULL AS INTEGER) AS inc, CAST(NULL AS INTEGER) AS rival, 0 AS cnt, 0 AS dark, CAST(NULL AS INTEGER) AS floor FROM (SELECT DISTINCT device FROM piv)
  UNION ALL
  SELECT device, n, tick,
    CASE WHEN hold THEN p0 ELSE n0 END, CASE WHEN hold THEN p1 ELSE n1 END, CASE WHEN hold THEN p2 ELSE n2 END,
    CASE WHEN hold THEN inc ELSE coalesce(chosen, inc2) END,
    CASE WHEN hold THEN rival ELSE (CASE WHEN challenge AND cnt2 < 3 THEN best END) END,
    CASE WHEN hold THEN cnt ELSE (CASE WHEN challenge AND cnt2 < 3 THEN cnt2 ELSE 0 END) END,
    CASE WHEN hold THEN dark + 1 ELSE 0 END,
    CASE WHEN hold THEN NULL ELSE chosen END
  FROM (
    SELECT *, CASE WHEN best IS NULL THEN NULL WHEN inc2 IS NULL OR NOT inc_stands THEN best WHEN challenge AND cnt2 >= 3 THEN best ELSE inc2 END AS chosen
    FROM (
      SELECT *, coalesce(inc2 IS NOT NULL AND inc_stands AND best <> inc2 AND pbest - pinc >= 0.05e0, false) AS challenge, CASE WHEN rival = best THEN cnt + 1 ELSE 1 END AS cnt2
      FROM (
        SELECT *,
          CASE inc2 WHEN 0 THEN s0 IS NOT NULL WHEN 1 THEN s1 IS NOT NULL WHEN 2 THEN s2 IS NOT NULL ELSE false END AS inc_stands,
          CASE inc2 WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 END AS pinc,
          CASE WHEN s0 IS NOT NULL AND s0 >= coalesce(s1, -1) AND s0 >= coalesce(s2, -1) THEN 0 WHEN s1 IS NOT NULL AND s1 >= coalesce(s2, -1) THEN 1 WHEN s2 IS NOT NULL THEN 2 END AS best,
          greatest(coalesce(s0, -1), coalesce(s1, -1), coalesce(s2, -1)) AS pbest
        FROM (
          SELECT *, CASE WHEN c0 IS NOT NULL THEN n0 END AS s0, CASE WHEN c1 IS NOT NULL THEN n1 END AS s1, CASE WHEN c2 IS NOT NULL THEN n2 END AS s2
          FROM (
            SELECT *, m0 / (coalesce(m0, 0) + coalesce(m1, 0) + coalesce(m2, 0)) AS n0, m1 / (coalesce(m0, 0) + coalesce(m1, 0) + coalesce(m2, 0)) AS n1, m2 / (coalesce(m0, 0) + coalesce(m1, 0) + coalesce(m2, 0)) AS n2
            FROM (
              SELECT *, CASE WHEN q0 >= 0.01e0 THEN q0 END AS m0, CASE WHEN q1 >= 0.01e0 THEN q1 END AS m1, CASE WHEN q2 >= 0.01e0 THEN q2 END AS m2
              FROM (
                SELECT *, CASE WHEN hold THEN inc WHEN missing THEN NULL ELSE inc END AS inc2,
                  CASE WHEN p0 IS NOT NULL OR c0 IS NOT NULL THEN 0.7e0 * coalesce(p0, 0e0) + (1 - 0.7e0) * (coalesce(c0, 0e0) / total) END AS q0,
                  CASE WHEN p1 IS NOT NULL OR c1 IS NOT NULL THEN 0.7e0 * coalesce(p1, 0e0) + (1 - 0.7e0) * (coalesce(c1, 0e0) / total) END AS q1,
                  CASE WHEN p2 IS NOT NULL OR c2 IS NOT NULL THEN 0.7e0 * coalesce(p2, 0e0) + (1 - 0.7e0) * (coalesce(c2, 0e0) / total) END AS q2
                FROM (
                  SELECT *, missing AND dark < 3 AS hold
                  FROM (
                    SELECT f.device, piv.n, piv.tick, f.p0, f.p1, f.p2, f.inc, f.rival, f.cnt, f.dark, c0, c1, c2, coalesce(c0, 0) + coalesce(c1, 0) + coalesce(c2, 0) AS total,
                      coalesce(CASE f.inc WHEN 0 THEN c0 IS NULL AND f.p0 IS NOT NULL WHEN 1 THEN c1 IS NULL AND f.p1 IS NOT NULL WHEN 2 THEN c2 IS NULL AND f.p2 IS NOT NULL END, false) AS missing
                    FROM f JOIN piv ON piv.device = f.device AND piv.n = f.n + 1)))))))))
)"""
ELECTION_SQL = sql(
    SCORES + "," + ELECTION,
    "SELECT device, tick, floor, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2 FROM f WHERE n > 0",
    recursive=True,
)


@query(ELECTION_SQL)
def st4_floor_election(spark, sf):
    """Probabilities, incumbent with hysteresis and dark grace, one row a device and tick."""
    from ..operators.folds import elect_floors

    out = elect_floors(_fold_scores(spark, sf))
    return out.select("device", "tick", F.col("floor_seq").alias("floor"), *[F.round(F.col("probs")[F.lit(k)], 4).alias(f"p{k}") for k in range(3)])


KALMAN = """
k AS (
  SELECT ent, n, t, floor_seq, zx AS x, 0e0 AS vx, zy AS y, 0e0 AS vy, 3600e0 AS p00, 0e0 AS p01, 1600e0 AS p11 FROM o WHERE n = 1
  UNION ALL
  SELECT ent, n, t, floor_seq,
    CASE WHEN fresh THEN zx ELSE mx + g0 * (zx - mx) END, CASE WHEN fresh THEN 0e0 ELSE vx + g1 * (zx - mx) END,
    CASE WHEN fresh THEN zy ELSE my + g0 * (zy - my) END, CASE WHEN fresh THEN 0e0 ELSE vy + g1 * (zy - my) END,
    CASE WHEN fresh THEN 3600e0 ELSE (1 - g0) * q00 END, CASE WHEN fresh THEN 0e0 ELSE (1 - g0) * q01 END, CASE WHEN fresh THEN 1600e0 ELSE q11 - g1 * q01 END
  FROM (SELECT *, q00 / (q00 + 3600e0) AS g0, q01 / (q00 + 3600e0) AS g1
    FROM (SELECT *, x + dt * vx AS mx, y + dt * vy AS my, p00 + 2 * dt * p01 + dt * dt * p11 + dt * dt * dt * dt / 4 * 400e0 AS q00, p01 + dt * p11 + dt * dt * dt / 2 * 400e0 AS q01, p11 + dt * dt * 400e0 AS q11
      FROM (SELECT o.ent, o.n, o.t, o.zx, o.zy, o.floor_seq, o.floor_seq <> k.floor_seq OR o.t - k.t > 30 AS fresh, least(greatest(o.t - k.t, 1e-3), 10e0) AS dt, k.x, k.vx, k.y, k.vy, k.p00, k.p01, k.p11
        FROM k JOIN o ON o.ent = k.ent AND o.n = k.n + 1)))
)"""
KALMAN_SQL = sql(
    RECORDING + """,
o AS (SELECT ent, CAST(updated AS DOUBLE) + (CASE WHEN event_id % 31 = 0 THEN 0e0 ELSE 0e0 END) AS t, raw_x AS zx, raw_y AS zy, floor_seq, row_number() OVER (PARTITION BY ent ORDER BY updated, event_id) AS n FROM rc),""" + KALMAN,
    "SELECT ent, CAST(n AS INTEGER) AS n, round(x, 3) AS x, round(y, 3) AS y FROM k",
    recursive=True,
)


@query(KALMAN_SQL)
def m5_kalman(spark, sf):
    from ..operators.folds import smooth_fixes

    r = fx.recording(spark, sf).select("ent", "updated", "event_id", "floor_seq", F.col("raw_x").alias("zx"), F.col("raw_y").alias("zy"))
    out = smooth_fixes(r, scale=40.0)
    return out.select("ent", "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


FOUR = ", ".join(f"max(CASE WHEN rec_seq % 4 = {i} THEN r END) AS r{i}, max(CASE WHEN rec_seq % 4 = {i} THEN w END) AS w{i}" for i in range(4))
FIXES = (
    WEIGHTED + "," + EDGES + f""",
zb AS (SELECT floor_seq, min(ax) AS zx0, min(ay) AS zy0, max(ax) AS zx1, max(ay) AS zy1 FROM zed GROUP BY 1),
pg AS (SELECT device, tick, floor_seq, device || '/' || tick || '/' || floor_seq AS id, any_value(scale) AS scale, count(*) AS n, {FOUR}, avg(x) AS sx, avg(y) AS sy, min(x) AS rx0, min(y) AS ry0, max(x) AS rx1, max(y) AS ry1 FROM wt GROUP BY 1, 2, 3 HAVING count(*) >= 3),
pe0 AS (SELECT pg.*, least(rx0, zx0) AS ex0, least(ry0, zy0) AS ey0, greatest(rx1, zx1) AS ex1, greatest(ry1, zy1) AS ey1 FROM pg LEFT JOIN zb USING (floor_seq)),
pb AS (SELECT *, ex0 - m AS x0, ey0 - m AS y0, ex1 + m AS x1, ey1 + m AS y1 FROM (SELECT *, 0.1e0 * greatest(ex1 - ex0, ey1 - ey0, 1e0) AS m FROM pe0)),"""
    + solved("pb") + """,
fs AS (SELECT pb.device, pb.tick, pb.floor_seq, id, fx, fy, n, sqrt(num / den) * sqrt(n / greatest(n - 2e0, 1e0)) / scale AS rms_m FROM pb JOIN so USING (id)),
pts AS (SELECT id, floor_seq, fx AS px, fy AS py FROM fs),""" + point_zones("pts") + """,
dead AS (SELECT DISTINCT id FROM pz WHERE no_go AND odd AND d > 1e-9)"""
)


@query(sql(FIXES, "SELECT device, tick, floor_seq, round(fx, 1) AS fx, round(fy, 1) AS fy, round(rms_m, 4) AS rms_m, round((0.5e0 * least(1e0, n / 5e0) + 0.5e0 / (1 + (rms_m / 2e0) * (rms_m / 2e0))) * (CASE WHEN id IN (SELECT id FROM dead) THEN 0.15e0 ELSE 1e0 END), 4) AS conf FROM fs", recursive=True))
def m1_trilaterate(spark, sf):
    h = tk.hypotheses(_readings(spark, sf).repartition(fx.tasks(spark, sf), "device"), fx.zones(spark))
    return h.select("device", "tick", "floor_seq", F.round("fx", 1).alias("fx"), F.round("fy", 1).alias("fy"), F.round("rms_m", 4).alias("rms_m"), F.round("conf", 4).alias("conf"))


PUBLISHED = FIXES + """,
cf AS (SELECT fs.*, x0, y0, x1, y1, (0.5e0 * least(1e0, fs.n / 5e0) + 0.5e0 / (1 + (rms_m / 2e0) * (rms_m / 2e0))) * (CASE WHEN id IN (SELECT id FROM dead) THEN 0.15e0 ELSE 1e0 END) AS conf FROM fs JOIN pb USING (id)),
fl AS (SELECT device, tick, floor_seq, conf FROM cf),""" + ELECTION + """,
ch AS (SELECT cf.* FROM f JOIN cf ON cf.device = f.device AND cf.tick = f.tick AND cf.floor_seq = f.floor WHERE f.n > 0),
o AS (SELECT device AS ent, CAST(tick AS DOUBLE) AS t, fx AS zx, fy AS zy, floor_seq, row_number() OVER (PARTITION BY device ORDER BY tick) AS n FROM ch),""" + KALMAN


@query(sql(PUBLISHED, "SELECT ch.device, ch.tick, ch.floor_seq, round(least(greatest(k.x, x0), x1), 2) AS x, round(least(greatest(k.y, y0), y1), 2) AS y, round(fx, 2) AS raw_x, round(fy, 2) AS raw_y, round(rms_m, 4) AS rms_m, round(conf, 4) AS conf FROM ch JOIN k ON k.ent = ch.device AND k.t = ch.tick", recursive=True))
def st_published_fixes(spark, sf):
    """Solved, elected, smoothed and clipped fixes: the chain up to where zones come in."""
    n = fx.tasks(spark, sf)
    fixes = tk.fold_fixes(tk.hypotheses(_readings(spark, sf).repartition(n, "device"), fx.zones(spark)), tasks=n)
    return fixes.select("device", "tick", "floor_seq", *[F.round(c, 2).alias(c) for c in ("x", "y", "raw_x", "raw_y")], F.round("rms_m", 4).alias("rms_m"), F.round("conf", 4).alias("conf"))


@query()
def tracking(spark, sf):
    """The flagship: states in, published fixes out."""
    fixes = tk.track(_states(spark, sf), fx.receivers(spark), fx.zones(spark), fx.subzones(spark), tasks=fx.tasks(spark, sf))
    return tk.publish(fixes).drop("floors")


# The zone of a fix is that in which it lies, or the nearest one, as it is moved there.
LIVE = (
    PUBLISHED
    + """,
sm AS (SELECT ch.device, ch.tick, ch.floor_seq, ch.id, least(greatest(k.x, x0), x1) AS px, least(greatest(k.y, y0), y1) AS py, fx, fy, rms_m, conf FROM ch JOIN k ON k.ent = ch.device AND k.t = ch.tick),"""
    + point_zones("sm").replace("pe AS", "pe2 AS").replace("pz AS", "pz2 AS").replace("FROM pe ", "FROM pe2 ")
    + """,
zn AS (SELECT id, arg_min(zone, (CASE WHEN odd THEN 0e0 ELSE d END, zone_seq)) AS zone FROM pz2 WHERE NOT no_go GROUP BY id)"""
)


@query(sql(LIVE, "SELECT device, tick, floor_seq, round(fx, 2) AS raw_x, round(fy, 2) AS raw_y, round(rms_m, 4) AS rms_m, round(conf, 4) AS conf, zone FROM sm JOIN zn USING (id)", recursive=True))
def st_stream_tracking(spark, sf):
    """The live chain from raw states to zones, in three micro-batches, run to the end of what is there."""
    fixes = live_fixes(spark, sf)
    return fixes.select("device", "tick", "floor_seq", *[F.round(c, 2).alias(c) for c in ("raw_x", "raw_y")], F.round("rms_m", 4).alias("rms_m"), F.round("conf", 4).alias("conf"), "zone")


def live_fixes(spark, sf, parts: int = 3):
    """Fixes of the live chain over the telemetry, which arrives in ``parts``."""
    from types import SimpleNamespace

    from ..sources.files import work_folder
    from ..streaming.live import LiveTracker

    states = fx.sensor_states(spark, sf).select("tick", "entity_id", "state", "unit")
    source, folder = work_folder(spark, "stream-source"), work_folder(spark, "stream-sink")
    receivers = fx.receivers(spark)
    plan = SimpleNamespace(floors=receivers.select("floor_seq", "floor").distinct(), receivers=receivers, zones=fx.zones(spark), subzones=fx.subzones(spark), tracker_height=lambda: None)
    live = LiveTracker(spark, lambda: plan, folder)
    last = states.agg(F.max("tick")).first()[0] or 0
    for k in range(parts):
        # What has come so far is one micro-batch each time.
        states.filter(F.col("tick").between(k * (last + 1) // parts + (k > 0), (k + 1) * (last + 1) // parts)).write.mode("append").parquet(source)
        live.start(spark.readStream.schema(states.schema).parquet(source), folder + "-state", available_now=True).awaitTermination()
    return live.fixes()
