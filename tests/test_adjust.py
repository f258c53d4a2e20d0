"""Zone clean-up as joins and rounds against the plain floor-wise version."""

import random

import numpy as np
import plain_adjust as plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spatiotrack.functions import rings as rg
from spatiotrack.operators import adjust as ad
from spatiotrack.sources import fixtures as fx
from spatiotrack.sources.files import WorkTables

ROWS = "floor_seq int, zone_seq int, zone string, zone_id string, poly boolean, ring array<struct<x:double,y:double>>"


def frame(spark, rings, floor=0):
    return spark.createDataFrame([(floor, i, f"z{i}", f"id{i}", True, [tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)], ROWS)


def room(rng, x, y, w, h, wobble):
    return np.array([(px + rng.uniform(-wobble, wobble), py + rng.uniform(-wobble, wobble)) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])


def plan(rng, columns, rows, wobble=6):
    """Rooms in rows with gaps, overlaps and walls that end in the middle of others."""
    out = []
    for i in range(columns):
        for j in range(rows):
            out.append(room(rng, i * 200 + rng.choice([0, 0, 60]) * (j % 2), j * 150, rng.choice([196, 200, 230, 204]), rng.choice([146, 150, 170]), wobble))
    rng.shuffle(out)
    return out


def same_ring(a, b):
    """Equal areas, and every corner of either near the other's boundary."""
    a, b = np.array([(p["x"], p["y"]) for p in a]), np.array(b, float)
    if abs(abs(rg.signed_area(a)) - abs(rg.signed_area(b))) > 0.5:
        return False
    return rg.boundary_distance(a, b).max() < 0.01 and rg.boundary_distance(b, a).max() < 0.01


@pytest.mark.parametrize("seed", range(3))
def test_corners_weld_like_nearest_pairs_one_by_one(spark, seed):
    rng = random.Random(seed)
    rings = [np.array([(rng.randint(0, 140), rng.randint(0, 140)) for _ in range(4)], float) for _ in range(25)]
    rings += [rings[0].copy(), rings[1][::-1].copy()]
    fixed = [i in (3, 4) for i in range(len(rings))]
    order = [i for i in range(len(rings)) if not fixed[i]] + [3, 4]
    want = plain.weld([rings[i] for i in order], [fixed[i] for i in order])
    rows = [("f", (i if not fixed[i] else ad.FIXED + i), fixed[i], [tuple(map(float, p)) for p in rings[i]]) for i in order]
    df = spark.createDataFrame(rows, "grp string, seq int, fixed boolean, ring array<struct<x:double,y:double>>")
    got = {r.seq: [(p.x, p.y) for p in r.welded] for r in ad.weld(df, WorkTables()).collect()}
    assert len(got) == len(rings) - 2
    for i, w in zip(order, want, strict=True):
        if not fixed[i]:
            assert np.allclose(np.array(got[i]).reshape(-1, 2), w, atol=1e-9), i


@pytest.mark.parametrize("straighten", [True, False])
def test_floors_equal_the_plain_version(spark, straighten):
    rng = random.Random(4)
    floors = [plan(rng, 3, 3), plan(rng, 4, 2, 9), plan(rng, 2, 2, 2), [np.array([(0, 0), (1, 1)])], [np.array([(0, 0), (90, 0), (90, 90), (0, 90)], float)] * 3]
    zones = None
    for k, rings in enumerate(floors):
        zones = frame(spark, rings, k) if zones is None else zones.unionByName(frame(spark, rings, k))
    got = {(r.floor_seq, r.seq): r for r in ad.adjust_zones(zones, straighten=straighten).collect()}
    assert len(got) == sum(map(len, floors))
    assert got[3, 0].note.startswith("skipped") and len(got[3, 0].ring) == 2
    for k in (0, 1, 2, 4):
        rings, squared, notes = plain.adjust_group(floors[k], straighten=straighten)
        for i, r in enumerate(rings):
            row = got[k, i]
            assert row.squared == squared[i] and row.note == notes[i] and same_ring(row.ring, r), (k, i)


def test_ten_thousand_rooms_of_one_floor(spark):
    rng = random.Random(9)
    rings = plan(rng, 100, 100)
    out = ad.adjust_zones(frame(spark, rings).repartition(8))
    got = {r.seq: r for r in out.collect()}
    want, squared, notes = plain.adjust_group(rings)
    off = [i for i in range(len(rings)) if not same_ring(got[i].ring, want[i])]
    assert len(got) == 10_000 and not off, off[:9]
    assert all(got[i].squared == squared[i] and got[i].note == notes[i] for i in range(len(rings)))


def test_overlaps_go_and_no_room_goes(spark):
    rng = random.Random(2)
    rings = [room(rng, rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(20, 400), rng.uniform(20, 400), 0) for _ in range(60)]
    # A long chain, a copy, a ring inside a larger one, and a ring of no area.
    rings += [room(rng, 3000 + 50 * i, 0, 60, 90 - i, 0) for i in range(12)] + [rings[5].copy()] + [room(rng, 5000, 0, 100, 100, 0), room(rng, 5010, 10, 20, 20, 0)] + [np.array([(0, 0), (9, 9), (18, 18)], float)]
    rows = [("f", i, [tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)]
    got = {r.seq: r.ring for r in ad.without_overlaps(spark.createDataFrame(rows, "grp string, seq int, ring array<struct<x:double,y:double>>"), WorkTables()).collect()}
    assert set(got) == set(range(len(rings)))
    done = []
    for i in sorted(range(len(rings)), key=lambda i: (-abs(rg.signed_area(rings[i])), i)):
        parts = [rg.turned(rings[i])]
        for other in done:
            if not plain_apart(rings[i], other):
                parts = [q for part in parts for q in rg.clip(part, other, keep_inside=False)]
        left = max(parts, key=lambda r: abs(rg.signed_area(r)), default=None)
        if left is not None and abs(rg.signed_area(rings[i])) > 0:
            done.append(rg.turned(left))
        assert same_ring(got[i], rings[i] if left is None else left), i
    assert same_ring(got[72], rings[5]) or abs(rg.signed_area(rings[5])) == 0


def plain_apart(a, b):
    return (a.max(axis=0) <= b.min(axis=0)).any() or (b.max(axis=0) <= a.min(axis=0)).any()


def test_subzones_stay_inside_their_parent(spark):
    rng = random.Random(6)
    zones = frame(spark, [np.array([(0, 0), (600, 0), (600, 400), (0, 400)], float), np.array([(700, 0), (900, 0), (900, 200), (700, 200)], float)])
    subs = [("id0", room(rng, -10, 5, 300, 200, 4)), ("z0", room(rng, 290, 8, 330, 190, 4)), ("id0", room(rng, 5000, 0, 50, 50, 1)), ("id0", room(rng, 285, 190, 100, 230, 4)), (None, room(rng, 0, 0, 90, 90, 0)), ("gone", room(rng, 0, 0, 90, 90, 0)), ("id1", np.array([(0, 0), (1, 1)]))]
    df = spark.createDataFrame([(0, i, f"s{i}", p, [tuple(map(float, q)) for q in r]) for i, (p, r) in enumerate(subs)], "floor_seq int, sub_seq int, sub_zone string, parent string, ring array<struct<x:double,y:double>>")
    got = {r.seq: r for r in ad.adjust_subzones(zones, df).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and got[2].note == "not inside its parent zone" and same_ring(got[5].ring, subs[5][1]) and same_ring(got[4].ring, subs[4][1])
    members = [0, 2, 3]
    wall = np.array([(0, 0), (600, 0), (600, 400), (0, 400)], float)
    rings, squared, notes = plain.adjust_group([subs[i][1] for i in members], fixed=[wall], clamp=wall)
    for i, r, did, note in zip(members, rings, squared, notes, strict=True):
        assert same_ring(got[i].ring, r) and got[i].squared == did and got[i].note == note, i
    alone = plain.adjust_group([subs[1][1]], fixed=[wall], clamp=wall)[0][0]
    assert same_ring(got[1].ring, alone)


def test_empty_layouts(spark):
    assert ad.adjust_zones(frame(spark, [])).count() == 0


def test_parts_of_rings_that_cross_themselves():
    rng = random.Random(3)
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 6)], float)
    assert rg.crosses_itself(bow) and not rg.crosses_itself(np.array([(0, 0), (9, 0), (9, 9), (0, 9)], float))
    # A spike, a ring walked twice, a ring that touches itself, one without area.
    assert abs(rg.signed_area(rg.largest_part(np.array([(0, 0), (10, 0), (20, 0), (10, 0), (10, 10), (0, 10)], float)))) == pytest.approx(100)
    assert rg.largest_part(np.array([(0, 0), (5, 5), (10, 10)], float)) is None
    for _ in range(40):
        r = np.array([(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(4, 8))], float)
        found = rg.parts(r)
        # Squares of a fine lattice, by the even-odd rule.
        x, y = np.meshgrid(np.arange(0.05, 40, 0.1), np.arange(0.05, 40, 0.1))
        p = np.stack([x.ravel(), y.ravel()], axis=1)
        want = rg.inside(p, r)
        got = np.zeros(len(p), bool)
        for part in found:
            got |= rg.inside(p, part)
        # Holes of a part are not told apart from it, so parts may cover more, never less.
        assert (got | ~want).mean() > 0.995 and all(rg.signed_area(q) > 0 or len(found) == 1 for q in found)


def test_rings_meet_by_shuffle_and_not_through_the_driver(spark):
    rings = frame(spark, plan(random.Random(1), 2, 2)).selectExpr("cast(floor_seq as string) grp", "floor_seq", "zone_seq seq", "false fixed", "ring")
    v = rings.selectExpr("grp", "floor_seq", "seq", "seq ring", "posexplode(ring) (vertex, p)").selectExpr("*", "p.x", "p.y", "seq * 4l + vertex v", "seq * 4l + vertex c")
    for df in (ad.corner_pairs(v, 22.0), ad.near_pairs(v, 22.0), ad.walls_near(v, rings), ad.overlaps(rings.selectExpr("grp", "seq", "seq place", "ring"))):
        shown = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_rings_of_a_batch_are_cut_as_one_by_one():
    rng = random.Random(4)
    rings = [None, []] + [ad._points(np.array([(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(1, 9))], float)) for _ in range(200)]
    one = [r if r is None or len(r) < 3 else ad._points(rg.largest_part(ad._array(r))) or [] for r in rings]
    assert ad._whole(pa.array(rings)).to_pylist() == one


def test_rooms_of_one_file_are_made_by_many_tasks(spark, sf):
    from spatiotrack.plans import zones

    assert all(df.rdd.getNumPartitions() > 1 for df in (zones._rooms(spark, sf), fx.rooms(spark, sf), zones.z2_largest_part(spark, sf), zones.z6_squared_rooms(spark, sf)))


def test_overlaps_of_a_batch_are_those_of_each_pair():
    rng = random.Random(8)
    rings = [ad._points(r) for r in plan(rng, 4, 4)] + [ad._points(room(rng, 200 * i, 0, 200, 150, 0)) for i in range(4)]
    rings += [ad._points(np.array([(0, 0), (300, 0), (300, 90), (120, 90), (120, 200), (0, 200)], float)), ad._points(np.array([(120, 90), (240, 90), (240, 200), (120, 200)], float))]
    pairs = [(a, b) for a in rings for b in rings]
    want = [ad.overlap_area(a, b) for a, b in pairs]
    got = ad._common(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).to_pylist()
    assert got == want and 0 < sum(w > rg.EPS for w in want) < len(want)


def test_rooms_that_share_a_wall_are_not_clipped(monkeypatch):
    rng = random.Random(8)
    # Neighbours whose common wall is aslant, as welding leaves them.
    slant = [(200 + rng.uniform(-9, 9), 0.0), (200 + rng.uniform(-9, 9), 150.0)]
    left, right = np.array([(0, 0), slant[0], slant[1], (0, 150)], float), np.array([slant[0], (400, 0), (400, 150), slant[1]], float)
    monkeypatch.setattr(ad, "overlap_area", lambda a, b: pytest.fail("clipped"))
    assert ad._common(pa.array([ad._points(left)] * 3), pa.array([ad._points(right)] * 3)).to_pylist() == [0.0] * 3


def odd_rings(rng):
    """Rooms turned and not, either way round, some with corners on walls or close together, and rings of any shape."""
    out = [room(rng, 0, 0, rng.uniform(30, 300), rng.uniform(30, 300), rng.choice([0, 2, 9, 30])) for _ in range(150)]
    for i, r in enumerate(out[:75]):
        a = rng.uniform(0, 6)
        out[i] = (r @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) + rng.uniform(0, 500))[:: rng.choice([1, -1])]
    out += [np.insert(r, 1, r[0] * 0.4 + r[1] * 0.6 + rng.choice([0, 1e-9, 2]), axis=0) for r in out[:40]]
    return out + [np.array([(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(rng.randint(3, 9))], float) for _ in range(80)]


def test_rings_of_a_batch_are_squared_and_thinned_as_one_by_one():
    rings = [None, []] + [ad._points(r) for r in odd_rings(random.Random(11))]
    assert ad._squared(pa.array(rings), ad.DEFAULTS).to_pylist() == [ad._square_one(r, ad.DEFAULTS) for r in rings]
    assert ad._thinned(pa.array(rings), 3.0).to_pylist() == [None if r is None else ad._points(ad.dedupe(ad._array(r), 3.0)) for r in rings]


def test_rings_of_a_batch_are_clipped_as_one_by_one():
    rng = random.Random(12)
    rings = odd_rings(rng)
    pairs = [(a, rng.choice([a + rng.choice([0, 10, 50]), rng.choice(rings)])) for a in rings]
    # Shared walls, corners on walls, and the same box.
    pairs += [tuple(room(rng, *[rng.randrange(0, 60, 10) for _ in "xy"], *[rng.randrange(10, 60, 10) for _ in "wh"], 0) for _ in "ab") for _ in range(150)]
    a, b = (pa.array([ad._points(p[k]) for p in pairs]) for k in (0, 1))
    assert ad._all_clamped(a, b).to_pylist() == [ad._clamped(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    assert ad._common(a, b).to_pylist() == [ad.overlap_area(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    assert ad._all_clamped(a.slice(3, 2), pa.array([None, []], a.type)).to_pylist() == [{"ring": x, "ok": True} for x in a.slice(3, 2).to_pylist()]


def test_ordinary_rooms_are_not_looked_at_one_by_one(monkeypatch):
    rng = random.Random(13)
    rooms = [room(rng, 0, 0, 200, 150, 6) for _ in range(50)]
    reach = [np.array([(120, 40), (240, 40), (240, 110), (120, 110), (117, 70)], float) for _ in rooms]
    for name in ("square", "dedupe", "_array", "overlap_area", "_clamped"):
        monkeypatch.setattr(ad, name, lambda *_, name=name: pytest.fail(name))
    a, b = (pa.array([ad._points(r) for r in rings]) for rings in (reach, rooms))
    assert all(x["squared"] for x in ad._squared(b, ad.DEFAULTS).to_pylist()) and ad._thinned(b, 3.0).to_pylist() == b.to_pylist()
    moves = ad._moved(b, a).to_pylist()
    assert all(m == pytest.approx(rg.boundary_distance(p, q).max(), abs=1e-9) for m, p, q in zip(moves, rooms, reach, strict=True))
    assert all(x["ok"] and max(p["x"] for p in x["ring"]) < 210 for x in ad._all_clamped(a, b).to_pylist()) and min(ad._common(a, b).to_pylist()) > 1


def test_long_rings_and_points_move_as_far_as_one_by_one():
    circle = lambda n, r: np.stack([r * np.cos(np.arange(n) * 2 * np.pi / n), r * np.sin(np.arange(n) * 2 * np.pi / n)], axis=1)
    old, new = [circle(700, 90), np.array([(3, 4)], float), np.zeros((0, 2)), circle(9, 5)], [circle(600, 100), np.array([(0, 0), (0, 0)], float), circle(5, 1), np.zeros((0, 2))]
    got = ad._moved(pa.array([*map(ad._points, old), None], ad._POINTS), pa.array([*map(ad._points, new), None], ad._POINTS)).to_pylist()
    assert got[0] == pytest.approx(rg.boundary_distance(old[0], new[0]).max(), abs=1e-9) and got[1:] == [5.0, None, None, None]
    a, b = (pa.array([ad._points(r)]) for r in (circle(400, 90), circle(401, 91) + 20))
    assert ad._all_clamped(a, b).to_pylist() == [ad._clamped(a[0].as_py(), b[0].as_py())]


def test_parents_of_any_name_are_told_apart(spark):
    """No floor and parent make the same group as others, a missing parent's neither."""
    box = [(0.0, 0.0), (80.0, 0.0), (80.0, 80.0), (0.0, 80.0)]
    names = [("1", "2:1"), ("1:2", "1"), ("1", None), ("", None), (None, None), ("1:", None), ("1", ""), (None, ":1"), ("", "1")]
    df = spark.createDataFrame([(f, 0, "s", p, box) for f, p in names], "floor_seq string, sub_seq int, sub_zone string, parent string, ring array<struct<x:double,y:double>>")
    zones = frame(spark, []).withColumn("floor_seq", F.lit(None).cast("string"))
    assert [len(r.ring) for r in ad.adjust_subzones(zones, df).collect()] == [4] * len(names)


def test_near_places_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    places = [("f", i, float(rng.randint(-150, 150)), float(rng.choice([-176, -88, -22, 0, 66, 88, 110]) + rng.choice([0, 0, 22, -22, 5]))) for i in range(150)]
    got = {(r.ca, r.cb): r.d for r in ad.near_pairs(spark.createDataFrame(places, "grp string, c long, x double, y double"), 22.0).collect()}
    want = {(i, j): np.sqrt((x - u) ** 2 + (y - v) ** 2) for _, i, x, y in places for _, j, u, v in places if i < j and 0 < np.sqrt((x - u) ** 2 + (y - v) ** 2) <= 22}
    assert got == pytest.approx(want)
