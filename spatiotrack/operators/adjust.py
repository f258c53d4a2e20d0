"""Clean-up of hand-drawn zones: square boxy rooms, weld shared walls, remove overlaps, clamp sub-zones.

No step puts a floor together. Squaring looks at one ring a row. Corners meet corners and walls by
joins on grid cells; clusters of corners grow in rounds in which mutually nearest ones merge, which
gives what taking all pairs from the nearest on would give. Overlaps are found by joins of boxes on
cells of their own size, and are cut off in rounds: a ring's turn comes when all larger rings that
overlap it are final, and a row of the cutting step holds one ring and those. The number of rounds
is the length of the longest chain of corners, or of overlapping rings, not the number of rings.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..functions import geometry as g
from ..functions import rings as rg
from ..sources.files import WorkTables


def met(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of tables that grow alike: always by shuffle, as the few bytes of packed rings in a file would let Spark send millions of them through the driver."""
    return left.join(right.hint("merge"), on, how)


def settings(options: dict | None, s: Settings = DEFAULTS) -> Settings:
    """Settings with those options that are given."""
    return replace(s, **{k: v for k, v in (options or {}).items() if v is not None})


def clean_rings(zones: DataFrame) -> DataFrame:
    """Rings of finite points; four corners stored row by row in walking order."""
    ok = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    z = zones.withColumn("ring", ok)
    return z.withColumn("ring", F.when(~F.coalesce("poly", F.lit(False)) & (F.size("ring") == 4), g.corner_order(F.col("ring"))).otherwise(F.col("ring")))


def cluster_values(values: DataFrame, tolerance: float) -> DataFrame:
    """(grp, id, value) with ``center``: the mean of the run of neighbours no further apart than the tolerance."""
    w = Window.partitionBy("grp").orderBy("value", "id")
    cut = F.when(F.col("value") - F.lag("value").over(w) > tolerance, 1).otherwise(0)
    runs = values.withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(w))
    return runs.withColumn("center", F.avg("value").over(Window.partitionBy("grp", "__run"))).drop("__cut", "__run")


def _cluster(v: np.ndarray, tolerance: float) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(v[order]) > tolerance)])
    mean = np.bincount(run, weights=v[order]) / np.bincount(run)
    out = np.empty(len(v))
    out[order] = mean[run]
    return out


def dedupe(r: np.ndarray, least: float) -> np.ndarray:
    """Without points closer than ``least`` to the last one kept."""
    keep: list[np.ndarray] = []
    for p in r:
        if not keep or np.hypot(*(p - keep[-1])) >= least:
            keep.append(p)
    if len(keep) >= 2 and np.hypot(*(keep[0] - keep[-1])) < least:
        keep.pop()
    return np.array(keep).reshape(-1, 2)


def square(r: np.ndarray, s: Settings = DEFAULTS) -> tuple[np.ndarray, bool]:
    """A nearly rectangular room with its sides along its main axis; others unchanged."""
    axis, box = rg.smallest_rectangle(r)
    d = np.roll(r, -1, axis=0) - r
    length = np.hypot(d[:, 0], d[:, 1])
    gap = np.abs(np.degrees(np.arctan2(d[:, 1], d[:, 0])) % 90 - np.degrees(axis) % 90)
    straight = length[np.minimum(gap, 90 - gap) < s.angle_deg].sum()
    area = abs(rg.signed_area(r))
    if not length.sum() or not box or straight / length.sum() < s.boxy_aligned or area / box < s.boxy_fill:
        return r, False
    c = rg.centroid(r)
    turn = np.array([[np.cos(axis), -np.sin(axis)], [np.sin(axis), np.cos(axis)]])
    flat = (r - c) @ turn
    out = dedupe(np.stack([_cluster(flat[:, 0], s.tolerance_px), _cluster(flat[:, 1], s.tolerance_px)], axis=1) @ turn.T + c, s.min_edge_px)
    if len(out) < 3 or abs(rg.signed_area(out)) < area * 0.5:
        return r, False
    return out, True


def _cluster_all(v: np.ndarray, tolerance: float) -> np.ndarray:
    """``_cluster`` of each row."""
    order = np.argsort(v, axis=1, kind="stable")
    ordered = np.take_along_axis(v, order, axis=1)
    run = np.cumsum(np.diff(ordered, axis=1, prepend=ordered[:, :1]) > tolerance, axis=1) + np.arange(len(v))[:, None] * v.shape[1]
    out = np.empty_like(v)
    np.put_along_axis(out, order, (np.bincount(run.ravel(), ordered.ravel()) / np.maximum(np.bincount(run.ravel()), 1))[run], axis=1)
    return out


def _square_all(r: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Of rings (m, n, 2): axis (degrees), share of the rectangle that is filled, whether squared, what results; last, for which this holds: those clearly convex that lose no corner."""
    ok, h = rg.convex_hulls(r)
    r, h = r[ok], h[ok]
    axis, box = rg.smallest_rectangles(h)
    d = np.roll(r, -1, axis=1) - r
    length = np.hypot(d[:, :, 0], d[:, :, 1])
    gap = np.abs(np.degrees(np.arctan2(d[:, :, 1], d[:, :, 0])) % 90 - (np.degrees(axis) % 90)[:, None])
    straight = np.where(np.minimum(gap, 90 - gap) < s.angle_deg, length, 0.0).sum(axis=1)
    area = np.abs(rg.areas(r))
    boxy = (straight / length.sum(axis=1) >= s.boxy_aligned) & (area / box >= s.boxy_fill)
    c, n = r.mean(axis=1), np.roll(r, -1, axis=1)
    cross = r[:, :, 0] * n[:, :, 1] - n[:, :, 0] * r[:, :, 1]
    whole = cross.sum(axis=1)
    c = np.where(whole[:, None] != 0, ((r + n) * cross[:, :, None]).sum(axis=1) / (3 * np.where(whole, whole, 1.0))[:, None], c)[:, None]
    turn = np.moveaxis(np.array([[np.cos(axis), -np.sin(axis)], [np.sin(axis), np.cos(axis)]]), 2, 0)
    flat = (r - c) @ turn
    out = np.stack([_cluster_all(flat[:, :, 0], s.tolerance_px), _cluster_all(flat[:, :, 1], s.tolerance_px)], axis=2) @ turn.swapaxes(1, 2) + c
    side = out - np.roll(out, 1, axis=1)
    apart = (np.hypot(side[:, :, 0], side[:, :, 1]) >= s.min_edge_px).all(axis=1)
    squared = boxy & (np.abs(rg.areas(out)) >= area * 0.5)
    ok[np.flatnonzero(ok)[boxy & ~apart]] = False
    sure = ~boxy | apart
    return np.degrees(axis[sure]) % 90, area[sure] / box[sure], squared[sure], np.where(squared[:, None, None], out, r)[sure], ok


def _array(ring) -> np.ndarray:
    return np.array([[q["x"], q["y"]] for q in ring], float).reshape(-1, 2)


def _square_one(ring: list | None, s: Settings) -> dict | None:
    r = _array(ring or [])
    if len(r) < 3:
        return None
    axis, box = rg.smallest_rectangle(r)
    out, did = square(r, s)
    return {"axis_deg": float(np.degrees(axis) % 90), "fill": float(abs(rg.signed_area(r)) / box) if box else 0.0, "squared": did, "ring": _points(out)}


def _squared(rings: pa.Array, s: Settings) -> pa.Array:
    """A batch of rings looked at together by their number of corners; what is not clearly convex, or loses corners, one by one."""
    alone, new = np.ones(len(rings), bool), []
    for rows, r in _alike(rings):
        *made, out, ok = _square_all(r, s)
        new.append((rows[ok], pa.StructArray.from_arrays([*map(pa.array, made), _lists(out)], fields=list(_SQUARED))))
        alone[rows[ok]] = False
    rows = np.flatnonzero(alone)
    new.append((rows, pa.array([_square_one(x, s) for x in rings.take(pa.array(rows)).to_pylist()], _SQUARED)))
    return _placed(len(rings), new)


SQUARED = "struct<axis_deg:double,fill:double,squared:boolean,ring:array<struct<x:double,y:double>>>"


def squared_rings(zones: DataFrame, s: Settings = DEFAULTS, ring: str = "ring", to: str = "square") -> DataFrame:
    """``zones`` with a struct: main axis (degrees from 0 to 90), share of the smallest rectangle that the ring fills, whether it was squared, the ring that results.

    One ring a row, whatever floor it is on; null for a ring of fewer than three points.
    """

    made = F.arrow_udf(lambda rings: _squared(rings, s), SQUARED)
    return zones.withColumn(to, made(F.col(ring)))


POINTS = "array<struct<x:double,y:double>>"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_SQUARED = pa.struct([("axis_deg", pa.float64()), ("fill", pa.float64()), ("squared", pa.bool_()), ("ring", _POINTS)])
_CLAMPED = pa.struct([("ring", _POINTS), ("ok", pa.bool_())])

#: A fixed ring's number, after those of all movable ones.
FIXED = 1 << 30
#: Side of the cells that corners and walls are entered in, in tolerances.
CELL = 8


def _points(r: np.ndarray | None) -> list[dict] | None:
    return None if r is None else [{"x": float(x), "y": float(y)} for x, y in r]


def ring_map(fn, kind: str = POINTS, arrow: pa.DataType = _POINTS):
    """Column function that calls ``fn`` with the rings of one row."""
    return F.arrow_udf(lambda *columns: pa.array([fn(*row) for row in zip(*[c.to_pylist() for c in columns], strict=True)], arrow), kind)


def _corner(ring: str = "seq", vertex: str = "vertex"):
    return F.shiftleft(F.col(ring).cast("long"), 32) + F.col(vertex)


def corner_clusters(rings: DataFrame, work: WorkTables, s: Settings = DEFAULTS) -> DataFrame:
    """Corners (grp, seq, vertex, v, x, y, fixed) of ``rings`` (grp, seq, fixed, ring) with the cluster they are in.

    Pairs of corners of different rings within the tolerance merge from the nearest pair on, unless a
    ring would have two corners in one cluster. A pair that is the first one left of both its clusters
    has none before it that could change either, so all such pairs merge at once, round by round; pairs
    that conflict never cease to and go. Corners at the very same place merge without any pair.
    """
    v = rings.select("grp", "seq", "fixed", F.posexplode("ring").alias("vertex", "p")).select("grp", "seq", "vertex", _corner().alias("v"), "p.x", "p.y", "fixed")
    turn = v.withColumn("__k", F.row_number().over(Window.partitionBy("grp", "x", "y", "seq").orderBy("vertex")))
    v = work.keep(turn.withColumn("c", F.min("v").over(Window.partitionBy("grp", "x", "y", "__k"))).drop("__k"), "corners")

    places = v.filter("v = c").select("grp", "c", "x", "y")
    pairs = near_pairs(places, s.tolerance_px).select("grp", "d", F.col("ca").alias("a"), F.col("cb").alias("b"), "ca", "cb")
    pairs = work.keep(pairs, "corner-pairs")
    ends = pairs.select("grp", F.explode(F.array("ca", "cb")).alias("c")).distinct()
    told = work.keep(met(v, ends.withColumn("__near", F.lit(True)), ["grp", "c"], "left"), "corners-near")
    rest, held = (told.filter(f"__near is {some} null").drop("__near") for some in ("", "not"))
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        rings_of = held.select("grp", "c", "seq")
        shared = met(met(pairs.select("grp", "a", "b", "ca", "cb"), rings_of.withColumnRenamed("c", "ca"), ["grp", "ca"]), rings_of.withColumnRenamed("c", "cb"), ["grp", "cb", "seq"], "left_semi")
        left = work.keep(met(pairs, shared.select("grp", "a", "b").distinct(), ["grp", "a", "b"], "left_anti"), "corner-pairs")
        first = left.select("grp", F.explode(F.array("ca", "cb")).alias("c"), F.struct("d", "a", "b", "ca", "cb").alias("e")).groupBy("grp", "c").agg(F.min("e").alias("e"))
        chosen = first.groupBy("grp", "e").count().filter("count = 2")
        merged = work.keep(chosen.select("grp", F.greatest("e.ca", "e.cb").alias("old"), F.least("e.ca", "e.cb").alias("new")), "corner-merges")

        def renamed(df: DataFrame, column: str, merged: DataFrame = merged) -> DataFrame:
            to = merged.select("grp", F.col("old").alias(column), F.col("new").alias("__new"))
            return met(df, to, ["grp", column], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")

        after = work.keep(renamed(renamed(left, "ca"), "cb").filter("ca <> cb"), "corner-pairs")
        now = work.keep(renamed(held, "c"), "corners-near")
        work.drop(pairs, left, merged, *rounds)
        pairs, held, rounds = after, now, [now]
    return rest.unionByName(held)


def near_pairs(places: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of different places (grp, c, x, y) within the tolerance: grp, d, ca < cb.

    An equi-join on grid cells, each place in its own and on the other side in all, mostly one or two, that hold a point within the tolerance.
    """
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / (tolerance * CELL))
    # A little more, so that no rounding at a cell's edge parts a pair.
    wide = tolerance * 1.001
    cells = lambda c: F.explode(F.sequence(cell(c, -wide), cell(c, wide)))
    a = places.select("grp", F.col("c").alias("ca"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = places.select("grp", F.col("c").alias("cb"), F.col("x").alias("bx"), F.col("y").alias("by"), cells("x").alias("cx")).withColumn("cy", cells("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    found = met(a, b, ["grp", "cx", "cy"]).filter("ca < cb").withColumn("d", F.sqrt(dx * dx + dy * dy))
    return found.filter((F.col("d") <= tolerance) & ((dx != 0) | (dy != 0))).select("grp", "d", "ca", "cb")


def welded_corners(clusters: DataFrame) -> DataFrame:
    """``clusters`` with to_x, to_y: a cluster's first fixed corner, else its mean; fixed corners stay."""
    whole = Window.partitionBy("grp", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wall = F.min(F.when(F.col("fixed"), F.struct("v", "x", "y"))).over(whole)
    many = F.count("*").over(whole) > 1
    at = lambda c: F.when(~F.col("fixed") & many, F.coalesce(F.col("__wall")[c], F.avg(c).over(whole))).otherwise(F.col(c)).alias(f"to_{c}")
    return clusters.withColumn("__wall", wall).select("*", at("x"), at("y")).drop("__wall")


def walls_near(corners: DataFrame, rings: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Each of ``corners`` (grp, seq, v, x, y) that lies near the inside of another ring's wall: the nearest such wall.

    Result: grp, seq, v, d, wall_seq, wall (the vertex at which it starts), wall_fixed, x, y (the foot). Walls are
    entered in all cells that a point within the tolerance of them may be in, a corner is in one cell.
    """
    tol, cell = s.tolerance_px, s.tolerance_px * CELL
    e = rings.select("grp", F.col("seq").alias("wall_seq"), F.col("fixed").alias("wall_fixed"), F.posexplode(g.edges(F.col("ring"))).alias("wall", "e")).select("grp", "wall_seq", "wall_fixed", "wall", "e.*")
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    e = e.withColumn("cx", F.explode(F.sequence(F.floor((low - tol) / cell), F.floor((high + tol) / cell))))
    # The stretch of the wall that points of this column of cells may be near to.
    slope = F.when(F.col("bx") != F.col("ax"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    y_at = lambda x: F.col("ay") + slope * (x - F.col("ax"))
    y1 = F.coalesce(y_at(F.greatest(low, F.col("cx") * cell - tol)), F.col("ay"))
    y2 = F.coalesce(y_at(F.least(high, (F.col("cx") + 1) * cell + tol)), F.col("by"))
    e = e.withColumn("cy", F.explode(F.sequence(F.floor((F.least(y1, y2) - tol) / cell - 1e-9), F.floor((F.greatest(y1, y2) + tol) / cell + 1e-9))))
    p = corners.select("grp", "seq", "v", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    j = met(p, e, ["grp", "cx", "cy"]).filter("seq <> wall_seq")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    j = j.withColumn("size", F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-300)))
    j = j.withColumn("along", ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.col("size"))
    j = j.filter((F.col("along") > tol) & (F.col("along") < F.col("size") - tol))
    j = j.withColumn("fx", F.col("ax") + F.col("along") / F.col("size") * dx).withColumn("fy", F.col("ay") + F.col("along") / F.col("size") * dy)
    gx, gy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    j = j.withColumn("d", F.sqrt(gx * gx + gy * gy)).filter(F.col("d") <= tol)
    best = j.groupBy("grp", "seq", "v").agg(F.min(F.struct("d", "wall_seq", "wall", "wall_fixed", F.col("fx").alias("x"), F.col("fy").alias("y"))).alias("b"))
    return best.select("grp", "seq", "v", "b.*")


def weld(rings: DataFrame, work: WorkTables, s: Settings = DEFAULTS) -> DataFrame:
    """grp, seq, welded: movable rings of ``rings`` (grp, seq, fixed, ring) whose near corners meet, and whose other corners lie on near walls.

    Fixed rings attract and stay, and get no corner.
    """
    to = work.keep(welded_corners(corner_clusters(rings, work, s)), "corners-welded")
    still = to.filter("not fixed and to_x = x and to_y = y")
    feet = work.keep(walls_near(still, rings, s), "corners-on-walls")
    own = feet.select("grp", "v", F.col("x").alias("__fx"), F.col("y").alias("__fy"))
    moved = met(to, own, ["grp", "v"], "left").withColumn("to_x", F.coalesce("__fx", "to_x")).withColumn("to_y", F.coalesce("__fy", "to_y"))
    corners = moved.filter("not fixed").select("grp", "seq", F.col("vertex").alias("k"), F.lit(0.0).alias("along"), F.lit(-1).cast("long").alias("v"), F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y")).alias("p"))
    start = moved.filter("not fixed").select("grp", F.col("seq").alias("wall_seq"), F.col("vertex").alias("wall"), "to_x", "to_y")
    gx, gy = F.col("x") - F.col("to_x"), F.col("y") - F.col("to_y")
    added = met(feet.filter("not wall_fixed"), start, ["grp", "wall_seq", "wall"]).select("grp", F.col("wall_seq").alias("seq"), F.col("wall").alias("k"), F.sqrt(gx * gx + gy * gy).alias("along"), "v", F.struct("x", "y").alias("p"))
    walk = F.transform(F.sort_array(F.collect_list(F.struct("k", "along", "v", "p"))), lambda w: w["p"])
    thin = F.arrow_udf(lambda rings: _thinned(rings, s.min_edge_px), POINTS)
    return corners.unionByName(added).groupBy("grp", "seq").agg(walk.alias("welded")).withColumn("welded", thin("welded"))


def _largest(rings: list[np.ndarray]) -> np.ndarray | None:
    return max(rings, key=lambda r: abs(rg.signed_area(r)), default=None)


def _unpacked(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of each ring (-1: null), where they start, and all corners of a batch."""
    sizes = pc.fill_null(pc.list_value_length(rings), -1).to_numpy(zero_copy_only=False)
    flat = rings.flatten()
    points = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
    return sizes, np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]).astype(np.int64), points


def _alike(*rings: pa.Array, cost: int = 40, least: int = 3, most: int = 512):
    """Rows of a batch whose rings, of ``least`` corners or more and ``most`` in all, have equally many, and these rings (m, n, 2): some at a time, by about ``cost`` bytes for each pair of corners."""
    sizes, start, points = zip(*map(_unpacked, rings), strict=True)
    if not len(sizes[0]):
        return
    kinds, kind = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
    for k in np.flatnonzero((kinds >= least).all(axis=1) & (kinds.sum(axis=1) <= most)):
        rows, n = np.flatnonzero(kind.ravel() == k), kinds[k]
        for some in np.array_split(rows, max(1, len(rows) * int(n.sum()) ** 2 * cost // 80_000_000)):
            yield some, *[p[at[some][:, None] + np.arange(m)] for p, at, m in zip(points, start, n, strict=True)]


def _lists(r: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """Rings (m, n, 2), of which some corners may be left out."""
    keep = np.ones(r.shape[:2], bool) if keep is None else keep
    p = r[keep]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), pa.int32()), pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], fields=list(_POINTS.value_type)))


def _placed(n: int, made: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """A batch of ``n`` rows from values and the rows they are for; later ones count."""
    take, at = np.zeros(n, np.int64), 0
    for rows, values in made:
        take[rows] = at + np.arange(len(values))
        at += len(values)
    return pa.concat_arrays([values for _, values in made]).take(pa.array(take))


def _whole(rings: pa.Array) -> pa.Array:
    """The rings of a batch, looked at together by their number of corners; only those that cross themselves are cut one by one."""
    sizes, start, points = _unpacked(rings)
    take, new = np.arange(len(rings)), []
    for n in np.unique(sizes[sizes >= 3]):
        rows = np.flatnonzero(sizes == n)
        for some in np.array_split(rows, max(1, len(rows) * int(n) // 500_000)):
            r = points[start[some][:, None] + np.arange(n)]
            crossed = rg.crossed(r)
            turn = np.roll(r, -1, axis=1)
            nothing = ~crossed & (np.abs((r[:, :, 0] * turn[:, :, 1] - turn[:, :, 0] * r[:, :, 1]).sum(axis=1) / 2) < rg.EPS)
            for k in np.flatnonzero(crossed | nothing):
                take[some[k]] = len(rings) + len(new)
                new.append([] if nothing[k] else _points(_largest(rg.crossed_parts(r[k]))) or [])
    return pa.concat_arrays([rings, pa.array(new, rings.type)]).take(pa.array(take)) if new else rings


def _thinned(rings: pa.Array, least: float) -> pa.Array:
    """``dedupe`` of a batch: only rings with corners closer than ``least`` to the one before are gone through."""
    sizes, start, points = _unpacked(rings)
    sizes = np.maximum(sizes, 0)
    before = np.arange(len(points)) - 1
    before[start[sizes > 0]] += sizes[sizes > 0]
    close = ~(np.hypot(*(points - points[before]).T) >= least)
    rows = np.unique(np.repeat(np.arange(len(rings)), sizes)[close])
    new = [_points(dedupe(_array(r), least)) for r in rings.take(pa.array(rows)).to_pylist()]
    return _placed(len(rings), [(np.arange(len(rings)), rings.cast(_POINTS)), (rows, pa.array(new, _POINTS))])


def whole_rings(zones: DataFrame, ring: str = "ring") -> DataFrame:
    """``zones`` with rings that cross themselves replaced by the largest part of what they enclose (even-odd), empty where there is none; others stay as they are."""
    return zones.withColumn(ring, F.arrow_udf(_whole, POINTS)(F.col(ring)))


def overlap_area(a: list, b: list) -> float:
    return float(sum(rg.signed_area(r) for r in rg.clip(_array(a), _array(b), keep_inside=True)))


def _common(rings: pa.Array, others: pa.Array) -> pa.Array:
    """Overlap areas of a batch: pairs of rings that a side of either parts, as most neighbours', are told together and share nothing; the others are clipped, together where one ring at most is left."""
    out = np.zeros(len(rings))
    alone = np.ones(len(rings), bool)
    for rows, a, b in _alike(rings, others, cost=400):
        alone[rows] = False
        rest = ~(rg.parted(a, b) | rg.parted(b, a))
        rows = rows[rest]
        count, clipped = rg.clip_all(a[rest], b[rest], keep_inside=True)
        for k, r in clipped:
            out[rows[k]] = rg.areas(r)
        alone[rows[count < 0]] = True
    for r in np.flatnonzero(alone):
        out[r] = overlap_area(rings[r].as_py(), others[r].as_py())
    return pa.array(out)


def overlaps(shapes: DataFrame, least: float = rg.EPS) -> DataFrame:
    """grp, seq, larger: pairs of rings (grp, seq, place, ring) of which more than ``least`` is common, the one with the higher place first.

    A box is entered in the cells, at most four, of a grid as coarse as itself, and looked for in the same
    way in all coarser grids of its floor; a pair counts in the cell where its common box begins.
    """
    box = g.bounds(F.col("ring"))
    b = shapes.select("grp", "seq", "place", "ring", box.alias("b")).select("grp", "seq", "place", "ring", "b.*")
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1.0))
    b = b.withColumn("level", F.ceil(F.log2(side)).cast("int"))
    tops = b.groupBy("grp").agg(F.max("level").alias("__top"))

    def cells(df: DataFrame, level: str) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col(level))
        steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
        return df.withColumn("cx", steps("minx", "maxx")).withColumn("cy", steps("miny", "maxy"))

    names = ["place", "seq", "ring", "minx", "miny", "maxx", "maxy", "level"]
    own = cells(b, "level").select("grp", "cx", "cy", F.col("level").alias("at"), *[F.col(c).alias(f"o_{c}") for c in names])
    seek = cells(met(b, tops, "grp").withColumn("at", F.explode(F.sequence("level", "__top"))), "at").select("grp", "cx", "cy", "at", *names)
    # Of rings of one level, each pair is met from both sides: once is enough.
    j = met(own, seek, ["grp", "at", "cx", "cy"]).filter("o_level > level or o_place < place")
    x, y, size = F.greatest("minx", "o_minx"), F.greatest("miny", "o_miny"), F.pow(F.lit(2.0), F.col("at"))
    j = j.filter((x < F.least("maxx", "o_maxx")) & (y < F.least("maxy", "o_maxy")) & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy")))
    j = j.filter(F.arrow_udf(_common, "double")("ring", "o_ring") > least)
    first = F.col("place") < F.col("o_place")
    return j.select("grp", F.when(first, F.col("o_seq")).otherwise(F.col("seq")).alias("seq"), F.when(first, F.col("seq")).otherwise(F.col("o_seq")).alias("larger"))


def _cut(ring: list, others: list) -> list | None:
    """The largest part of a ring without the others; null if nothing is left."""
    parts = [rg.turned(_array(ring))]
    for other in others or []:
        parts = [q for part in parts for q in rg.clip(part, _array(other["ring"]), keep_inside=False)]
    left = _largest(parts)
    return None if left is None or len(left) < 3 else _points(rg.tidy(left))


def without_overlaps(shapes: DataFrame, work: WorkTables) -> DataFrame:
    """grp, seq, ring: rings (grp, seq, ring) less what larger ones (of equals: earlier ones) hold; none is dropped.

    A ring of which nothing would be left stays as it is and takes nothing from others, and so does the
    copy of an earlier ring.
    """
    area = g.area(F.col("ring"))
    shapes = shapes.withColumn("__area", area)
    # The place in the order, as one number that compares like (area descending, seq).
    place = F.struct((-F.col("__area")).alias("a"), F.col("seq").alias("s"))
    same = F.row_number().over(Window.partitionBy("grp", "ring").orderBy("seq"))
    shapes = work.keep(shapes.select("grp", "seq", "ring", place.alias("place"), same.alias("__copy")), "rings-welded")
    first = shapes.filter("__copy = 1 and size(ring) >= 3")
    pairs = work.keep(overlaps(first), "ring-overlaps")
    pending = met(first, pairs.select("grp", "seq").distinct(), ["grp", "seq"], "left_semi").select("grp", "seq", "place", "ring")
    free = met(first, pairs.select("grp", "seq").distinct(), ["grp", "seq"], "left_anti").select("grp", "seq", "place", "ring", F.lit(True).alias("cuts"))
    final = work.keep(free, "rings-final")
    pending = work.keep(pending, "rings-pending")
    while not pending.isEmpty():
        waits = met(pairs, pending.select("grp", F.col("seq").alias("larger")), ["grp", "larger"], "left_semi").select("grp", "seq").distinct()
        ready = met(pending, waits, ["grp", "seq"], "left_anti")
        holders = final.filter("cuts").select("grp", F.col("seq").alias("larger"), F.col("place").alias("__place"), F.col("ring").alias("__ring"))
        taken = met(pairs, holders, ["grp", "larger"]).groupBy("grp", "seq").agg(F.sort_array(F.collect_list(F.struct(F.col("__place").alias("place"), F.col("__ring").alias("ring")))).alias("others"))
        cut = met(ready, taken, ["grp", "seq"], "left").withColumn("left", ring_map(_cut)("ring", "others"))
        done = work.keep(cut.select("grp", "seq", "place", F.coalesce("left", "ring").alias("ring"), F.col("left").isNotNull().alias("cuts")), "rings-final")
        after = work.keep(met(pending, done, ["grp", "seq"], "left_anti"), "rings-pending")
        work.drop(pending)
        final, pending = final.unionByName(done), after
    rest = shapes.filter("__copy > 1 or size(ring) < 3").select("grp", "seq", "ring")
    return final.select("grp", "seq", "ring").unionByName(rest)


def _clamped(ring: list, clamp: list | None) -> dict:
    """A ring's largest part inside ``clamp``, and whether there is one of more than a square pixel."""
    r = _array(ring)
    if clamp is None or len(clamp) < 3 or len(r) < 3:
        return {"ring": ring, "ok": True}
    wall = rg.turned(_array(clamp))
    if (rg.inside(r, wall) | (rg.boundary_distance(r, wall) < rg.EPS)).all():
        return {"ring": ring, "ok": True}
    inner = _largest(rg.clip(r, wall, keep_inside=True))
    if inner is None or abs(rg.signed_area(inner)) <= 1:
        return {"ring": ring, "ok": False}
    return {"ring": _points(rg.tidy(inner)), "ok": True}


def _all_clamped(rings: pa.Array, walls: pa.Array) -> pa.Array:
    """``_clamped`` of a batch: rings inside their walls are told together, the others are clipped together where one ring at most is left."""
    n = len(rings)
    kept = lambda rows, ok: pa.StructArray.from_arrays([rings.take(pa.array(rows)).cast(_POINTS), pa.array(np.full(len(rows), ok))], fields=list(_CLAMPED))
    new = [(np.arange(n), kept(np.arange(n), True))]
    alone = pc.fill_null(pc.and_(*[pc.greater_equal(pc.list_value_length(x), 3) for x in (rings, walls)]), False).to_numpy(zero_copy_only=False).copy()
    for rows, r, wall in _alike(rings, walls, cost=400):
        alone[rows] = False
        wall = rg.all_turned(wall)
        rest = ~(rg.all_inside(r, wall) | (rg.all_distances(r, wall) < rg.EPS)).all(axis=1)
        rows = rows[rest]
        count, clipped = rg.clip_all(r[rest], wall[rest], keep_inside=True)
        new.append((rows[count == 0], kept(rows[count == 0], False)))
        for k, inner in clipped:
            large = np.abs(rg.areas(inner)) > 1
            new.append((rows[k[~large]], kept(rows[k[~large]], False)))
            new.append((rows[k[large]], pa.StructArray.from_arrays([_lists(inner[large], rg.bends(inner[large])), pa.array(large[large])], fields=list(_CLAMPED))))
        alone[rows[count < 0]] = True
    rows = np.flatnonzero(alone)
    new.append((rows, pa.array([_clamped(rings[k].as_py(), walls[k].as_py()) for k in rows], _CLAMPED)))
    return _placed(n, new)


def _adjusted(rows: DataFrame, straighten: bool, s: Settings, walls: DataFrame | None = None) -> DataFrame:
    """RESULT of ``rows`` (grp, floor_seq, seq, name, ring); ``walls`` (grp, wall): a fixed ring of each group that also clamps."""
    work = WorkTables()
    rows = whole_rings(rows)
    z = squared_rings(rows, s) if straighten else rows.withColumn("square", F.lit(None).cast(SQUARED))
    z = work.keep(z.withColumn("squared", F.coalesce(F.col("square.squared"), F.lit(False))).withColumn("made", F.coalesce(F.col("square.ring"), F.col("ring"))).drop("square"), "rings-squared")
    usable = z.filter(F.size("ring") >= 3)
    rings = usable.select("grp", "seq", F.lit(False).alias("fixed"), F.col("made").alias("ring"))
    if walls is not None:
        rings = rings.unionByName(walls.select("grp", F.lit(FIXED).alias("seq"), F.lit(True).alias("fixed"), F.col("wall").alias("ring")))
    # A ring that welding made cross itself keeps its largest part.
    half = met(usable.select("grp", "seq", "ring"), whole_rings(weld(rings, work, s), "welded"), ["grp", "seq"])
    keeps = F.coalesce((F.size("welded") >= 3) & (g.area(F.col("welded")) >= 0.5 * g.area(F.col("ring"))), F.lit(False))
    # Written once before it is used twice: higher-order functions that a plan holds twice were seen to disagree.
    half = work.keep(half.withColumn("kept", keeps), "rings-half")
    done = without_overlaps(half.select("grp", "seq", F.when(F.col("kept"), F.col("welded")).otherwise(F.col("ring")).alias("ring")), work)
    note = F.when(~F.col("kept"), "kept as drawn: over half of its area would be lost").otherwise("")
    done = met(done, half.select("grp", "seq", "kept"), ["grp", "seq"]).withColumn("note", note)
    if walls is not None:
        clamp = F.arrow_udf(_all_clamped, f"struct<ring:{POINTS},ok:boolean>")
        done = met(done, walls.select("grp", "wall"), "grp", "left").withColumn("clamp", clamp("ring", "wall"))
        done = done.withColumn("ring", F.col("clamp.ring")).withColumn("note", F.when(F.col("clamp.ok"), F.col("note")).otherwise("not inside its parent zone"))
    done = work.keep(done.select("grp", "seq", F.col("ring").alias("new"), "note"), "rings-adjusted")
    work.keep_only(z, done)
    tidy = lambda c: F.transform(c, lambda p: F.struct(F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y")))
    out = met(z, done, ["grp", "seq"], "left")
    skipped = F.when(F.size("ring") < 3, "skipped (invalid polygon)").otherwise("")
    return out.select("floor_seq", "seq", "name", "squared", F.coalesce("note", skipped).alias("note"), tidy(F.col("ring")).alias("old"), tidy(F.coalesce("new", "ring")).alias("ring"))


def adjust_zones(zones: DataFrame, options: dict | None = None, straighten: bool = True) -> DataFrame:
    """Cleaned main zones: floor_seq, seq, name, squared, note, old, ring; a ring of fewer than three points is passed through."""
    rows = clean_rings(zones).select(F.col("floor_seq").cast("string").alias("grp"), "floor_seq", F.col("zone_seq").alias("seq"), F.col("zone").alias("name"), "ring")
    return _adjusted(rows, straighten, settings(options))


def adjust_subzones(zones: DataFrame, subzones: DataFrame, options: dict | None = None, straighten: bool = True) -> DataFrame:
    """Cleaned sub-zones, per parent: welded to its walls and to each other, clamped inside it; see adjust_zones for the columns.

    A parent is named by its id, or by its name where it has no id or no zone has that id; of several the last.
    Sub-zones of fewer than three points are left out.
    """
    # Floor, parent and the floor's length, which keeps them apart; what differs comes first, as sorting looks at few bytes.
    floor, none = F.col("floor_seq").cast("string"), F.lit("")
    group = lambda parent: F.concat(F.coalesce(floor, none), F.coalesce(F.concat(F.lit(":"), parent), none), F.lit(":"), F.coalesce(F.length(floor).cast("string"), none))
    z = clean_rings(zones).filter(F.size("ring") >= 3)
    named = z.select("floor_seq", "zone_seq", "ring", F.inline(F.array(F.struct(F.coalesce("zone_id", "zone").alias("parent"), F.lit(1).alias("by_id")), F.struct(F.col("zone").alias("parent"), F.lit(0).alias("by_id")))))
    walls = named.groupBy("floor_seq", "parent").agg(F.max_by("ring", F.struct("by_id", "zone_seq")).alias("wall"))
    subs = clean_rings(subzones.withColumn("poly", F.lit(True))).filter(F.size("ring") >= 3)
    rows = subs.select(group("parent").alias("grp"), "floor_seq", F.col("sub_seq").alias("seq"), F.col("sub_zone").alias("name"), "ring")
    used = met(walls, subs.select("floor_seq", "parent").distinct(), ["floor_seq", "parent"], "left_semi").select(group("parent").alias("grp"), "wall")
    return _adjusted(rows, straighten, settings(options), used)


def _moved(old: pa.Array, new: pa.Array) -> pa.Array:
    """How far the old corner that is farthest from the new ring lies from it; null where either has no corner."""
    out = np.full(len(old), np.nan)
    for rows, p, r in _alike(old, new, cost=100, least=1, most=1 << 31):
        # Of long rings some corners at a time.
        for some in np.array_split(p, max(1, p.shape[1] * r.shape[1] // 200_000), axis=1):
            gx, gy = rg.all_gaps(some, r)
            out[rows] = np.fmax(out[rows], np.sqrt(gx * gx + gy * gy).min(axis=2).max(axis=1))
    return pa.array(out, from_pandas=True)


def change_report(result: DataFrame) -> DataFrame:
    """Per ring: largest move of a vertex, change of area, vertices before and after."""
    move = F.arrow_udf(_moved, "double")("old", "ring")
    r = result.withColumn("__move", move).withColumn("__before", g.area(F.col("old"))).withColumn("__after", g.area(F.col("ring")))
    before, after = F.col("__before"), F.col("__after")
    return r.select("floor_seq", "seq", "name", "squared", F.round("__move", 1).alias("max_move_px"), F.round(F.when(before > 0, (after - before) / before * 100).otherwise(0.0), 1).alias("area_change_pct"), F.size("old").alias("vertices_before"), F.size("ring").alias("vertices_after"), "note")


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("floor_seq").agg(F.count_if("squared").alias("n_squared"), F.count_if(F.col("max_move_px") > 1).alias("n_moved"), F.max("max_move_px").alias("max_move_px"))


def corner_pairs(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of vertices (floor_seq, ring, vertex, x, y) of different rings within the tolerance.

    An equi-join on grid cells of the tolerance's size, each vertex in its own and the eight around it.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = vertices.select("floor_seq", F.col("ring").alias("a_ring"), F.col("vertex").alias("a_vertex"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = vertices.select("floor_seq", F.col("ring").alias("b_ring"), F.col("vertex").alias("b_vertex"), F.col("x").alias("bx"), F.col("y").alias("by"), F.inline(near))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return met(a, b, ["floor_seq", "cx", "cy"]).filter("a_ring < b_ring").withColumn("d", d).filter(F.col("d") <= tolerance).select("floor_seq", "a_ring", "a_vertex", "b_ring", "b_vertex", "d")
