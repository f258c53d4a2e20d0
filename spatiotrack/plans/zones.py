"""Queries of zone clean-up and of the layout document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import adjust as ad
from ..sources import files
from ..sources import fixtures as fx
from .common import ROOMS6, SUPPLIED, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# Hand-drawn rooms: three by the customer of each order block, with integer wobble.
ROOMS = "rm AS (SELECT c_custkey // 4 AS floor_seq, c_custkey % 4 AS seq, c_custkey AS k FROM customer), vx AS (SELECT floor_seq, seq, k, i, CAST(seq * 204 + CASE WHEN i IN (1, 2) THEN 200 ELSE 0 END + (k * (7 + i * 5)) % 9 - 4 AS DOUBLE) AS x, CAST(CASE WHEN i IN (2, 3) THEN 150 ELSE 0 END + (k * (11 + i * 3)) % 7 - 3 AS DOUBLE) AS y FROM rm, range(4) AS t(i))"


def _rooms(spark, sf):
    k = F.col("c_custkey")
    c = fx.spread(fx.table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.expr("cast(c_custkey div 4 as int)").alias("floor_seq"), (k % 4).cast("int").alias("zone_seq"), k.alias("k"))

    def corner(i: int):
        x = F.col("zone_seq") * 204 + (200 if i in (1, 2) else 0) + (F.col("k") * (7 + i * 5)) % 9 - 4
        y = (150 if i in (2, 3) else 0) + (F.col("k") * (11 + i * 3)) % 7 - 3
        return F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if isinstance(y, int) else y.cast("double").alias("y"))

    return c.select("floor_seq", "zone_seq", F.concat(F.lit("room"), "k").alias("zone"), F.concat(F.lit("r"), "k").alias("zone_id"), F.lit(True).alias("poly"), F.array(*[corner(i) for i in range(4)]).alias("ring"))


@query(sql(ROOMS + ", c AS (SELECT *, CASE WHEN x - lag(x) OVER w > 22 THEN 1 ELSE 0 END AS cut FROM vx WINDOW w AS (PARTITION BY floor_seq ORDER BY x, seq * 10 + i)), r AS (SELECT *, sum(cut) OVER (PARTITION BY floor_seq ORDER BY x, seq * 10 + i) AS run FROM c)", "SELECT floor_seq AS grp, seq * 10 + i AS id, round(avg(x) OVER (PARTITION BY floor_seq, run), 6) AS center FROM r"))
def z4_cluster_values(spark, sf):
    v = _rooms(spark, sf).select(F.col("floor_seq").cast("long").alias("grp"), "zone_seq", F.posexplode("ring").alias("i", "p"))
    rows = v.select("grp", (F.col("zone_seq").cast("long") * 10 + F.col("i")).alias("id"), F.col("p.x").alias("value"))
    return ad.cluster_values(rows, 22.0).select("grp", "id", F.round("center", 6).alias("center"))


@query(sql(ROOMS, "SELECT CAST(a.floor_seq AS INTEGER) AS floor_seq, CAST(a.seq AS INTEGER) AS a_ring, CAST(a.i AS INTEGER) AS a_vertex, CAST(b.seq AS INTEGER) AS b_ring, CAST(b.i AS INTEGER) AS b_vertex, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM vx a JOIN vx b ON a.floor_seq = b.floor_seq AND a.seq < b.seq WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 22 * 22"))
def z7_corner_pairs(spark, sf):
    v = _rooms(spark, sf).select("floor_seq", F.col("zone_seq").alias("ring"), F.posexplode("ring").alias("vertex", "p")).select("floor_seq", "ring", "vertex", "p.x", "p.y")
    return ad.corner_pairs(v, 22.0).withColumn("d", F.round("d", 6))


@query(sql(ROOMS + ", k AS (SELECT *, true AS kept, x AS kx, y AS ky FROM vx WHERE i = 0 UNION ALL SELECT v.*, pow(v.x - k.kx, 2) + pow(v.y - k.ky, 2) >= 22500, CASE WHEN pow(v.x - k.kx, 2) + pow(v.y - k.ky, 2) >= 22500 THEN v.x ELSE k.kx END, CASE WHEN pow(v.x - k.kx, 2) + pow(v.y - k.ky, 2) >= 22500 THEN v.y ELSE k.ky END FROM k JOIN vx v ON v.k = k.k AND v.i = k.i + 1), s AS (SELECT k, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_max(x, i) AS lx, arg_max(y, i) AS ly, count(*) AS n FROM k WHERE kept GROUP BY 1)", "SELECT k, CAST(CASE WHEN n >= 2 AND pow(fx - lx, 2) + pow(fy - ly, 2) < 22500 THEN n - 1 ELSE n END AS INTEGER) AS vertices FROM s", recursive=True))
def z3_dedupe_ring(spark, sf):
    """Vertices left of each room when those closer than 150 px to the last kept one go."""
    zero = F.expr("named_struct('out', cast(array() as array<struct<x:double,y:double>>))")
    far = lambda a, b: F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) >= 22500
    step = lambda acc, p: F.struct(F.when((F.size(acc["out"]) == 0) | far(p, F.get(acc["out"], F.size(acc["out"]) - 1)), F.concat(acc["out"], F.array(p))).otherwise(acc["out"]).alias("out"))
    kept = _rooms(spark, sf).select(F.substring("zone", 5, 20).cast("long").alias("k"), F.aggregate("ring", zero, step, lambda acc: acc["out"]).alias("out"))
    n = F.size("out")
    closing = (n >= 2) & ~far(F.col("out")[0], F.get("out", n - 1))
    return kept.select("k", F.when(closing, n - 1).otherwise(n).alias("vertices"))


@query(sql(ROOMS + ", e AS (SELECT k, x AS ax, y AS ay, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS b2, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM vx WINDOW w AS (PARTITION BY k ORDER BY i))", "SELECT k, round(abs(sum(ax * coalesce(b2, fy) - coalesce(bx, fx) * ay)) / 2, 6) AS area FROM e GROUP BY 1"))
def z13_room_area(spark, sf):
    return _rooms(spark, sf).select(F.substring("zone", 5, 20).cast("long").alias("k"), F.round(g.area(F.col("ring")), 6).alias("area"))


@query(sql("v AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS poly, CASE WHEN p_partkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE CAST(p_partkey % 40 AS DOUBLE) END AS x0 FROM part)", "SELECT k, CAST(CASE WHEN isnan(x0) THEN 3 ELSE 4 END AS INTEGER) AS n, CASE WHEN isnan(x0) THEN 30e0 WHEN poly THEN 30e0 ELSE 40e0 END AS third_x FROM v"))
def z1_clean_rings(spark, sf):
    k = F.col("p_partkey")
    x0 = F.when(k % 5 == 0, F.lit(float("nan"))).otherwise((k % 40).cast("double"))
    point = lambda x: F.struct(x.alias("x"), F.lit(1.0).alias("y"))
    z = fx.table(spark, sf, "part").select(k.alias("k"), (k % 3 == 0).alias("poly"), F.array(point(x0), point(F.lit(20.0)), point(F.lit(30.0)), point(F.lit(40.0))).alias("ring"))
    c = ad.clean_rings(z)
    third = F.when(F.size("ring") == 3, F.col("ring")[1]["x"]).otherwise(F.col("ring")[2]["x"])
    return c.select("k", F.size("ring").alias("n"), third.alias("third_x"))


# Rectangles turned by 5 to 84 degrees, and right triangles, which fill half of their rectangle.
@query(sql("v AS (SELECT p_partkey AS k, 100 + p_partkey % 50 AS w, 60 + p_partkey % 30 AS h FROM part)", "SELECT k, CASE WHEN k % 7 <> 0 THEN CAST(k % 80 + 5 AS DOUBLE) END AS axis_deg, CASE WHEN k % 7 = 0 THEN 0.5e0 ELSE 1e0 END AS fill, k % 7 <> 0 AS squared, CAST(CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END AS INTEGER) AS vertices, CASE WHEN k % 7 = 0 THEN w * h / 2e0 ELSE w * h * 1e0 END AS area FROM v"))
def z6_squared_rooms(spark, sf):
    k = F.col("k")
    turn = F.radians(k % 80 + 5)
    w, h = 100 + k % 50, 60 + k % 30
    at = lambda x, y: F.struct((500 + x * F.cos(turn) - y * F.sin(turn)).alias("x"), (400 + x * F.sin(turn) + y * F.cos(turn)).alias("y"))
    zero = F.lit(0.0)
    ring = F.when(k % 7 == 0, F.array(at(zero, zero), at(w, zero), at(zero, h))).otherwise(F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h)))
    z = ad.squared_rings(fx.spread(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k").withColumn("ring", ring))
    q = F.col("square")
    return z.select("k", F.when(k % 7 != 0, F.round(q["axis_deg"], 3)).alias("axis_deg"), F.round(q["fill"], 4).alias("fill"), q["squared"].alias("squared"), F.size(q["ring"]).alias("vertices"), F.round(g.area(q["ring"]), 2).alias("area"))


def _rooms6(spark, sf):
    """grp, floor_seq, seq, fixed, ring."""
    z = ad.clean_rings(fx.rooms(spark, sf))
    return z.select(F.col("floor_seq").cast("string").alias("grp"), "floor_seq", F.col("zone_seq").alias("seq"), F.lit(False).alias("fixed"), "ring")


# Rings that cross themselves once: two triangles, of which the larger stays; every third ring is a plain rectangle.
@query(sql("v AS (SELECT p_partkey AS k, 50e0 + p_partkey % 40 AS w, 20e0 + p_partkey % 17 AS a, 20e0 + (p_partkey * 7) % 23 AS b FROM part)", "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE 3 END AS INTEGER) AS vertices, round(CASE WHEN k % 3 = 0 THEN w * a ELSE greatest(a, b) * greatest(a, b) * w / (2 * (a + b)) END, 7) AS area FROM v WHERE k % 3 = 0 OR a <> b"))
def z2_largest_part(spark, sf):
    k = F.col("k")
    w, a, b = 50.0 + k % 40, 20.0 + k % 17, 20.0 + (k * 7) % 23
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.when(k % 3 == 0, F.array(at(zero, zero), at(w, zero), at(w, a), at(zero, a))).otherwise(F.array(at(zero, zero), at(w, a), at(w, zero), at(zero, b)))
    parts = fx.spread(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k")
    rings = parts.filter((k % 3 == 0) | (a != b)).select("k", ring.alias("ring"))
    z = ad.whole_rings(rings)
    # Seven places, as areas lie half-way between numbers of four, five and six.
    return z.select("k", F.size("ring").alias("vertices"), F.round(g.area(F.col("ring")), 7).alias("area"))


# All pairs of a floor from the nearest on, one at a time; labels are a list with one entry for each corner.
KRUSKAL = (
    ROOMS6
    + """,
pr AS (SELECT a.f, a.v AS a, b.v AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM vx a JOIN vx b ON a.f = b.f AND a.seq < b.seq),
ed AS (SELECT f, a, b, row_number() OVER (PARTITION BY f ORDER BY d, a, b) AS k FROM pr WHERE d <= 22),
st AS (SELECT f, 0 AS k, list(v ORDER BY v) AS lab FROM vx GROUP BY f
  UNION ALL
  SELECT f, k, CASE WHEN la = lb OR list_has_any(list_transform(list_filter(range(len(lab)), lambda v: lab[v + 1] = la), lambda v: v // 4), list_transform(list_filter(range(len(lab)), lambda v: lab[v + 1] = lb), lambda v: v // 4))
    THEN lab ELSE list_transform(lab, lambda l: CASE WHEN l = greatest(la, lb) THEN least(la, lb) ELSE l END) END
  FROM (SELECT st.f, ed.k, lab, lab[a + 1] AS la, lab[b + 1] AS lb FROM st JOIN ed ON ed.f = st.f AND ed.k = st.k + 1)),
lb AS (SELECT f, arg_max(lab, k) AS lab FROM st GROUP BY f),
cl AS (SELECT vx.*, lab[v + 1] AS c FROM vx JOIN lb USING (f)),
wd AS (SELECT *, count(*) OVER (PARTITION BY f, c) AS corners, avg(x) OVER (PARTITION BY f, c) AS to_x, avg(y) OVER (PARTITION BY f, c) AS to_y FROM cl)"""
)


@query(sql(KRUSKAL, "SELECT CAST(f AS INTEGER) AS floor_seq, CAST(seq AS INTEGER) AS seq, CAST(i AS INTEGER) AS vertex, corners, round(to_x, 6) AS to_x, round(to_y, 6) AS to_y FROM wd", recursive=True))
def z7_welded_corners(spark, sf):
    """Where each corner goes, and how many corners meet there."""
    to = ad.welded_corners(ad.corner_clusters(_rooms6(spark, sf), files.WorkTables()))
    corners = F.count("*").over(Window.partitionBy("grp", "c"))
    return to.select(F.col("grp").cast("int").alias("floor_seq"), "seq", "vertex", corners.alias("corners"), F.round("to_x", 6).alias("to_x"), F.round("to_y", 6).alias("to_y"))


@query(
    sql(
        ROOMS6
        + """,
eg AS (SELECT a.f, a.seq AS wall_seq, a.i AS wall, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM vx a JOIN vx b ON a.f = b.f AND a.seq = b.seq AND b.i = (a.i + 1) % 4),
al AS (SELECT p.f, p.seq, p.i, p.x, p.y, e.*, greatest(sqrt((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)), 1e-300) AS size FROM vx p JOIN eg e ON p.f = e.f AND p.seq <> e.wall_seq),
ag AS (SELECT *, ((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / size AS along FROM al),
ft AS (SELECT *, ax + along / size * (bx - ax) AS fx, ay + along / size * (bz - ay) AS fy FROM ag WHERE along > 22 AND along < size - 22),
nr AS (SELECT *, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d FROM ft),
bs AS (SELECT *, row_number() OVER (PARTITION BY f, seq, i ORDER BY d, wall_seq, wall) AS k FROM nr WHERE d <= 22)""",
        "SELECT CAST(f AS INTEGER) AS floor_seq, CAST(seq AS INTEGER) AS seq, CAST(i AS INTEGER) AS vertex, CAST(wall_seq AS INTEGER) AS wall_seq, CAST(wall AS INTEGER) AS wall, round(d, 6) AS d, round(fx, 6) AS x, round(fy, 6) AS y FROM bs WHERE k = 1",
    )
)
def z8_corners_on_walls(spark, sf):
    """For each corner near the inside of another room's wall: the wall, and the point on it."""
    rooms = _rooms6(spark, sf)
    corners = rooms.select("grp", "seq", F.posexplode("ring").alias("v", "p")).select("grp", "seq", "v", "p.*")
    near = ad.walls_near(corners.withColumn("v", F.col("seq") * 4 + F.col("v")), rooms)
    return near.select(F.col("grp").cast("int").alias("floor_seq"), "seq", (F.col("v") % 4).alias("vertex"), "wall_seq", "wall", F.round("d", 6).alias("d"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Rectangles that reach into their neighbour, to the right on even floors, downwards on odd ones. SQL gives every square of ten
# pixels to the largest room that holds it: areas are disjoint, and nothing is lost.
OVERLAPPING = """rc AS (SELECT p_partkey // 6 AS f, p_partkey % 6 AS seq, (p_partkey % 6) % 3 * 20 AS x0, (p_partkey % 6) // 3 * 15 AS y0,
  CASE WHEN (p_partkey // 6) % 2 = 0 THEN 20 + (p_partkey * 13) % 5 ELSE 20 - (p_partkey * 7) % 4 END AS w, CASE WHEN (p_partkey // 6) % 2 = 0 THEN 15 - (p_partkey * 7) % 4 ELSE 15 + (p_partkey * 13) % 5 END AS h FROM part),
sq AS (SELECT f, seq, w * h AS area, x0 + u AS x, y0 + t AS y FROM rc, range(25) AS a(u), range(20) AS b(t) WHERE u < w AND t < h),
ow AS (SELECT f, x, y, arg_min(seq, (-area, seq)) AS seq FROM sq GROUP BY ALL),
af AS (SELECT f, seq, count(*) * 100e0 AS after FROM ow GROUP BY ALL)"""


@query(sql(OVERLAPPING, "SELECT CAST(f AS INTEGER) AS floor_seq, CAST(seq AS INTEGER) AS seq, w * h * 100e0 AS area_before, after AS area_after FROM rc JOIN af USING (f, seq)"))
def z9_overlaps_removed(spark, sf):
    """Areas of rooms before and after the larger ones took what they share."""
    k, f = F.col("p_partkey"), F.expr("cast(p_partkey div 6 as int)")
    over, under = (k * 13) % 5 * 10, (k * 7) % 4 * 10
    x, y = (k % 6) % 3 * 200, F.expr("(p_partkey % 6) div 3") * 150
    w, h = F.when(f % 2 == 0, 200 + over).otherwise(200 - under), F.when(f % 2 == 0, 150 - under).otherwise(150 + over)
    at = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    rooms = fx.table(spark, sf, "part").select(f.cast("string").alias("grp"), (k % 6).cast("int").alias("seq"), F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)).alias("ring"))
    after = ad.without_overlaps(rooms, files.WorkTables()).select("grp", "seq", F.round(g.area(F.col("ring")), 3).alias("area_after"))
    before = rooms.select("grp", "seq", F.round(g.area(F.col("ring")), 3).alias("area_before"))
    return ad.met(before, after, ["grp", "seq"]).select(F.col("grp").cast("int").alias("floor_seq"), "seq", "area_before", "area_after")


@query()
def z11_adjust_zones(spark, sf):
    r = ad.change_report(ad.adjust_zones(_rooms(spark, sf)))
    return r


@query()
def z12_adjust_subzones(spark, sf):
    """Two sub-zones of each room, one near its upper wall, one that reaches over its right wall."""
    rooms = _rooms(spark, sf)
    p = F.col("ring")[0]
    at = lambda x, y: F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y"))
    box = lambda x, y, w, h: F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    subs = rooms.select("floor_seq", F.col("zone_id").alias("parent"), "zone_seq", F.posexplode(F.array(box(5, 6, 80, 60), box(92, 40, 130, 70))).alias("i", "ring"))
    subs = subs.select("floor_seq", (F.col("zone_seq") * 2 + F.col("i")).alias("sub_seq"), F.concat("parent", F.lit("s"), "i").alias("sub_zone"), "parent", "ring")
    return ad.change_report(ad.adjust_subzones(rooms, subs))


@query()
def a19_adjust_summary(spark, sf):
    return ad.summary(ad.change_report(ad.adjust_zones(_rooms(spark, sf))))


# Layout documents of eight floors each, built from receivers by supplier and rooms by part, and read back through the parser.
def _layout(spark, sf):
    r = fx.supplied(spark, sf)
    rec = F.sort_array(F.collect_list(F.struct("rec_seq", F.struct(F.col("scanner").alias("entity_id"), F.struct("x", "y").alias("cords"), "height", "correction").alias("v"))))
    per = r.groupBy("floor_seq", "floor", "scale").agg(F.transform(rec, lambda v: v["v"]).alias("receivers"))
    z = fx.rooms(spark, sf).groupBy("floor_seq").agg(F.sort_array(F.collect_list(F.struct("zone_seq", F.struct("zone_id", F.col("zone").alias("entity_id"), F.col("ring").alias("cords"), "poly", "no_go").alias("v")))).alias("z"))
    f = per.join(z, "floor_seq").select("floor_seq", F.struct(F.col("floor").alias("name"), "scale", "receivers", F.transform("z", lambda v: v["v"]).alias("zones")).alias("f"))
    floors = F.transform(F.sort_array(F.collect_list(F.struct("floor_seq", "f"))), lambda v: v["f"])
    doc = f.groupBy(F.expr("floor_seq div 8")).agg(F.to_json(F.struct(floors.alias("floor"))).alias("value")).select("value")
    broken = spark.range(1).select(F.lit('{"floor": [{"name": "x", "rece').alias("value"))
    return files.parse_layout(doc.unionByName(broken))


@query(sql(SUPPLIED, "SELECT CAST(floor_seq % 8 AS INTEGER) AS floor_seq, floor, CAST(rec_seq % 4 AS INTEGER) AS rec_seq, scanner, height FROM rec"))
def s14_placed_receivers(spark, sf):
    return files.receivers(_layout(spark, sf)).select("floor_seq", "floor", "rec_seq", "scanner", "height")


@query(sql(SUPPLIED, "SELECT scanner, height, round(correction, 6) AS correction FROM rec"))
def s16_selftest_receivers(spark, sf):
    return files.selftest_receivers(_layout(spark, sf)).select("scanner", "height", F.round("correction", 6).alias("correction"))


@query(sql(SUPPLIED, "SELECT scanner, scale FROM rec"))
def s15_calibration_receivers(spark, sf):
    return files.calibration_receivers(_layout(spark, sf)).select("scanner", "scale")


@query(sql(SUPPLIED, "SELECT scanner FROM rec"))
def s17_placed_slugs(spark, sf):
    return files.placed_slugs(_layout(spark, sf))


@query(sql(SUPPLIED + ", " + ROOMS6, "SELECT 'f' || f AS floor, CAST(seq AS INTEGER) AS zone_seq, 'z' || k AS zone_id, 'room' || k AS zone, k % 2 = 1 AS poly, k % 11 = 5 AS no_go, CAST(4 AS INTEGER) AS vertices FROM rm WHERE f IN (SELECT floor_seq FROM rec)"))
def s4_layout_zones(spark, sf):
    return files.zones(_layout(spark, sf)).select("floor", "zone_seq", "zone_id", "zone", "poly", "no_go", F.size("ring").alias("vertices"))


@query(sql("v AS (SELECT o_custkey AS ent, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS area FROM orders)", "SELECT ent, id, CAST(row_number() OVER (PARTITION BY ent ORDER BY area DESC, id) AS INTEGER) AS place FROM v"))
def l7_area_order(spark, sf):
    """Largest first, stable: here over the orders of a customer."""
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("ent"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("area"))
    return o.select("ent", "id", F.row_number().over(Window.partitionBy("ent").orderBy(F.desc("area"), "id")).alias("place"))
