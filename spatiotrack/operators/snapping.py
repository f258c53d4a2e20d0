"""Snapping of points into valid space where zones may be forbidden.

Valid space is the union of the allowed zones without the forbidden ones, which are grown by a
margin first. Where a floor has no forbidden zone the column expression of ``zones.snap_plain`` is
exact. Elsewhere a point's nearest valid point is one of few candidates: projections on zone edges
and on the grown boundary (offset edges and arcs around corners), and where those cross. Candidates
near by come from grids, for a batch of points at once; the valid ones are kept, the nearest taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from . import zones as zn

EPS = 1e-7


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of each member of runs that start at ``starts`` and have ``counts`` members."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))


class Grid:
    """Boxes (n, 4) entered in the square cells that they touch; about as many cells as boxes."""

    def __init__(self, boxes: np.ndarray):
        self.low = boxes[:, :2].min(axis=0)
        extent = np.maximum(boxes[:, 2:].max(axis=0) - self.low, 1.0)
        self.cell = max(float(np.sqrt(extent[0] * extent[1] / len(boxes))), float(extent.max()) / (4 * len(boxes) + 16))
        self.shape = np.floor(extent / self.cell).astype(np.int64) + 1
        first, last = self._at(boxes[:, :2]), self._at(boxes[:, 2:])
        wide, high = last[:, 0] - first[:, 0] + 1, last[:, 1] - first[:, 1] + 1
        box, k = _expand(np.zeros(len(boxes), np.int64), wide * high)
        cells = (first[box, 0] + k % wide[box]) * self.shape[1] + first[box, 1] + k // wide[box]
        order = np.argsort(cells, kind="stable")
        self.members = box[order]
        self.ends = np.searchsorted(cells[order], np.arange(self.shape[0] * self.shape[1] + 1))

    def _at(self, p: np.ndarray) -> np.ndarray:
        """Cells of points; those outside are counted to the rim."""
        return np.clip(np.floor((p - self.low) / self.cell).astype(np.int64), 0, self.shape - 1)

    def near(self, p: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (point, box) of the cells up to ``rings`` around each point, and the distance within which none is missed."""
        at = np.clip(np.floor((p - self.low) / self.cell), -(2.0**40), 2.0**40).astype(np.int64)
        first, last = np.maximum(at - rings, 0), np.minimum(at + rings, self.shape - 1)
        wide, high = np.maximum(last - first + 1, 0).T
        point, k = _expand(np.zeros(len(p), np.int64), wide * high)
        cells = (first[point, 0] + k % wide[point]) * self.shape[1] + first[point, 1] + k // wide[point]
        owner, member = _expand(self.ends[cells], self.ends[cells + 1] - self.ends[cells])
        pairs = np.unique(point[owner] * len(self.ends) * 4 + self.members[member]) if len(owner) else np.zeros(0, np.int64)
        whole = ((at - rings <= 0) & (at + rings >= self.shape - 1)).all(axis=1)
        return pairs // (len(self.ends) * 4), pairs % (len(self.ends) * 4), np.where(whole, np.inf, rings * self.cell)


class Region:
    """Allowed and forbidden rings of a floor, as edge arrays (n, 4).

    All that a point may be moved to lies on a feature: an allowed wall, a forbidden wall's offset, an arc
    around a forbidden corner, or a place where those cross. Features and rings are entered in grids; a
    point looks at the cells around it, in rings that double until nothing nearer can be further out,
    and a candidate is tested against the rings of its own cell. Work grows with the features near by.
    """

    def __init__(self, allowed: list[np.ndarray], forbidden: list[np.ndarray], margin: float):
        self.allowed, self.forbidden, self.margin = allowed, forbidden, margin
        self.rings = [*allowed, *forbidden]
        self.blocks = np.repeat([False, True], [len(allowed), len(forbidden)])
        if not self.rings:
            return
        sizes = np.array([len(e) for e in self.rings])
        self.edges, self.first, self.sizes = np.concatenate(self.rings), np.cumsum(sizes) - sizes, sizes
        boxes = np.array([[*e[:, :2].min(axis=0), *e[:, :2].max(axis=0)] for e in self.rings])
        grown = np.where(self.blocks, margin, 0.0)[:, None] + 2 * EPS
        self.boxes = np.concatenate([boxes[:, :2] - grown, boxes[:, 2:] + grown], axis=1)
        self.by_ring = Grid(self.boxes)
        self.lines = self._lines()
        self.corners = np.concatenate([e[:, :2] for e in forbidden]) if forbidden else np.zeros((0, 2))
        self.features = None

    @staticmethod
    def _distance(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of each point from the edge beside it."""
        d = e[:, 2:] - e[:, :2]
        t = np.clip(((p - e[:, :2]) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        return np.hypot(*(p - (e[:, :2] + t[:, None] * d)).T)

    def _against(self, p: np.ndarray, point: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of points and rings: inside (even-odd), distance from the boundary."""
        pair, edge = _expand(self.first[ring], self.sizes[ring])
        e, q = self.edges[edge], p[point[pair]]
        (ax, ay, bx, by), x, y = e.T, q[:, 0], q[:, 1]
        at = (bx - ax) * (y - ay) / np.where(by == ay, 1.0, by - ay) + ax
        crossed = ((ay > y) != (by > y)) & (x < at)
        odd = np.bincount(pair, crossed, len(ring)) % 2 == 1
        starts = np.cumsum(self.sizes[ring]) - self.sizes[ring]
        return odd, np.minimum.reduceat(self._distance(q, e), starts) if len(ring) else np.zeros(0)

    def _met(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points and rings whose grown box holds the point."""
        point, ring, _ = self.by_ring.near(p, 0)
        b, q = self.boxes[ring], p[point]
        hit = (q >= b[:, :2]).all(axis=1) & (q <= b[:, 2:]).all(axis=1)
        return point[hit], ring[hit]

    def _covered(self, p: np.ndarray, forbidden: bool) -> np.ndarray:
        point, ring = self._met(p)
        mine = self.blocks[ring] == forbidden
        point, ring = point[mine], ring[mine]
        odd, d = self._against(p, point, ring)
        out = np.zeros(len(p), bool)
        out[point[odd | (d <= EPS)]] = True
        return out

    def valid(self, p: np.ndarray) -> np.ndarray:
        """On an allowed ring, if there is one, and at least the margin away from every forbidden one."""
        if not self.rings:
            return np.ones(len(p), bool)
        point, ring = self._met(p)
        odd, d = self._against(p, point, ring)
        bad = self.blocks[ring]
        covered, dead = np.zeros(len(p), bool), np.zeros(len(p), bool)
        covered[point[~bad & (odd | (d <= EPS))]] = True
        dead[point[bad & (odd | (d < self.margin - EPS))]] = True
        return (covered | (not self.allowed)) & ~dead

    def _lines(self) -> np.ndarray:
        """Allowed edges and both offsets of forbidden edges."""
        out = [*self.allowed]
        for e in self.forbidden:
            d = e[:, 2:] - e[:, :2]
            normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)[:, None]
            for side in (1, -1):
                out.append(e + np.tile(normal * self.margin * side, 2))
        return np.concatenate(out)

    def crossings(self) -> np.ndarray:
        """Ends of lines, and where lines cross each other or a circle around a forbidden corner; pairs come from the grid."""
        lines = self.lines
        boxes = np.concatenate([np.minimum(lines[:, :2], lines[:, 2:]) - EPS, np.maximum(lines[:, :2], lines[:, 2:]) + EPS], axis=1)
        grid, points = Grid(boxes), [lines[:, :2], lines[:, 2:]]
        cell = np.repeat(np.arange(len(grid.ends) - 1), np.diff(grid.ends))
        one, k = _expand(grid.ends[cell], np.diff(grid.ends)[cell])
        i, j = grid.members[one], grid.members[k]
        pair = np.unique((i * len(lines) + j)[i < j])
        a, b = lines[pair // len(lines)], lines[pair % len(lines)]
        da, db, f = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
        det = da[:, 0] * db[:, 1] - da[:, 1] * db[:, 0]
        ok = np.abs(det) > 1e-12
        a, da, db, f, det = a[ok], da[ok], db[ok], f[ok], det[ok]
        t, u = (f[:, 0] * db[:, 1] - f[:, 1] * db[:, 0]) / det, (f[:, 0] * da[:, 1] - f[:, 1] * da[:, 0]) / det
        hit = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
        points.append(a[hit, :2] + t[hit, None] * da[hit])
        if len(self.corners):
            # Lines that a circle can touch are in the cells around its corner.
            corner, line, _ = grid.near(self.corners, int(np.ceil(self.margin / grid.cell)) + 1)
            d, f = lines[line, 2:] - lines[line, :2], lines[line, :2] - self.corners[corner]
            qa, qb, qc = (d * d).sum(axis=1), 2 * (f * d).sum(axis=1), (f * f).sum(axis=1) - self.margin**2
            disc = qb * qb - 4 * qa * qc
            ok = (disc >= 0) & (qa > 0)
            for sign in (1, -1):
                t = (-qb[ok] + sign * np.sqrt(disc[ok])) / (2 * qa[ok])
                hit = (t >= 0) & (t <= 1)
                points.append(lines[line[ok][hit], :2] + t[hit, None] * d[ok][hit])
        return np.concatenate(points)

    def _prepare(self) -> None:
        """Features: lines, corners with their arcs, valid crossings."""
        fixed = self.crossings()
        fixed = fixed[self.valid(fixed)]
        self.lasting = np.concatenate([self.lines, np.tile(self.corners, 2), np.tile(fixed, 2)])
        self.kind = np.repeat([0, 1, 2], [len(self.lines), len(self.corners), len(fixed)])
        room = np.where(self.kind == 1, self.margin, 0.0)[:, None]
        low, high = np.minimum(self.lasting[:, :2], self.lasting[:, 2:]) - room, np.maximum(self.lasting[:, :2], self.lasting[:, 2:]) + room
        self.features = Grid(np.concatenate([low, high], axis=1))

    def _candidates(self, q: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The nearest point of each feature to the point beside it."""
        e, kind = self.lasting[feature], self.kind[feature]
        d = e[:, 2:] - e[:, :2]
        t = np.clip(((q - e[:, :2]) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        out, arc = e[:, :2] + t[:, None] * d, kind == 1
        away = q[arc] - e[arc, :2]
        out[arc] = e[arc, :2] + away / np.maximum(np.hypot(away[:, 0], away[:, 1]), 1e-300)[:, None] * self.margin
        return out

    def snap(self, p: np.ndarray) -> np.ndarray:
        """Points as they are where that is allowed, else the nearest valid ones; where there is none, or no place at all, as they are."""
        out = p.copy()
        if not self.rings:
            return out
        finite = np.isfinite(p).all(axis=1)
        if not finite.all():
            out[finite] = self.snap(p[finite])
            return out
        # With forbidden zones only, a point on one goes to the nearest point of its grown boundary.
        todo = np.flatnonzero(~self.valid(p) if self.allowed else self._covered(p, True))
        if not len(todo):
            return out
        if self.features is None:
            self._prepare()
        rings = 1
        while len(todo):
            later = []
            # Points a few at a time: each may have all features around it.
            for some in np.array_split(todo, max(1, len(todo) // 256)):
                point, feature, sure = self.features.near(p[some], rings)
                c = self._candidates(p[some][point], feature)
                gap = np.hypot(*(c - p[some][point]).T)
                good = np.flatnonzero((self.kind[feature] == 2) | self.valid(c))
                order = good[np.lexsort((feature[good], gap[good], point[good]))]
                first = order[np.concatenate([[True], np.diff(point[order]) > 0])] if len(order) else order
                best = np.full(len(some), np.inf)
                best[point[first]] = gap[first]
                settled = (best <= sure) | np.isinf(sure)
                win = first[settled[point[first]]]
                out[some[point[win]]] = c[win]
                later.append(some[~settled])
            todo, rings = np.concatenate(later), 2 * rings
        return out


def _rings(zones: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edge arrays of the allowed and of the forbidden zones."""
    rings = [(z["no_go"], np.array([[e["ax"], e["ay"], e["bx"], e["by"]] for e in z["edges"]], float)) for z in zones]
    return [r for bad, r in rings if not bad], [r for bad, r in rings if bad]


def _moved(floors: np.ndarray, x: np.ndarray, y: np.ndarray, region) -> pa.Array:
    """Points of one batch, floor by floor; null where ``region`` has none for the floor."""
    x, y, there = x.astype(float), y.astype(float), np.zeros(len(x), bool)
    for k in np.unique(floors):
        rows = np.flatnonzero(floors == k)
        if (found := region(int(k), rows)) is not None:
            moved = found.snap(np.stack([x[rows], y[rows]], axis=1))
            x[rows], y[rows], there[rows] = moved[:, 0], moved[:, 1], True
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"], mask=pa.array(~there))


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.fill_null(-1).to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]


def _snapper(floors: dict[int, list] | None, margin: float):
    """Column function of floor, x and y, and of the floor's zones where ``floors`` are not given."""
    known: dict[int, Region] = {}

    def shipped(floor: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        def region(k: int, rows: np.ndarray) -> Region | None:
            if k not in known and k in floors:
                known[k] = Region(*_rings(floors[k]), margin)
            return known.get(k)

        return _moved(*_numbers(floor, x, y), region)

    def joined(floor: pa.Array, x: pa.Array, y: pa.Array, zones: pa.Array) -> pa.Array:
        def region(k: int, rows: np.ndarray) -> Region | None:
            at = zones[int(rows[0])].as_py()
            return None if at is None else Region(*_rings(at), margin)

        return _moved(*_numbers(floor, x, y), region)

    return F.arrow_udf(joined if floors is None else shipped, "struct<x:double,y:double>")


def snap_into_zones(points: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``points`` (floor_seq, x, y and others) moved to the nearest valid place, in one pass.

    Floors with a forbidden zone go to the tasks once, if all of them are small enough to be broadcast,
    else with the rows of those floors.
    """
    prepared = zn.prepared_zones(zones, s).withColumnRenamed("zones", "__zones")
    hard = prepared.filter(F.exists("__zones", lambda z: z["no_go"])).select("floor_seq", F.transform("__zones", lambda z: F.struct(z["no_go"].alias("no_go"), z["edges"].alias("edges"))).alias("zones"))
    few = zn.is_small(hard)
    floors = {r["floor_seq"]: [z.asDict() for z in r["zones"]] for r in hard.collect()} if few else None
    joined = points.join(zn.small(prepared), "floor_seq", "left")
    snapper = _snapper(floors, s.snap_margin_px)
    if few:
        moved = snapper(F.col("floor_seq"), F.col("x"), F.col("y")) if floors else F.lit(None).cast("struct<x:double,y:double>")
    else:
        forbidden = F.when(F.exists("__zones", lambda z: z["no_go"]), F.transform("__zones", lambda z: F.struct(z["no_go"].alias("no_go"), z["edges"].alias("edges"))))
        moved = snapper(F.col("floor_seq"), F.col("x"), F.col("y"), forbidden)
    plain = F.when(F.col("__zones").isNull(), F.struct("x", "y")).otherwise(zn.snap_plain(F.col("x"), F.col("y"), F.col("__zones")))
    placed = joined.withColumn("__moved", moved).withColumn("__p", F.coalesce("__moved", plain))
    return placed.select(*[F.col("__p")[c].alias(c) if c in ("x", "y") else F.col(c) for c in points.columns])
