"""Plane geometry on rings (``array<struct<x, y>>``) as column expressions.

A ring that crosses itself is read by the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOUCH = 1e-9


def edges(ring: Column) -> Column:
    """array<struct<ax, ay, bx, by>>: each vertex and the next one, the last one to the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, (i + 1) % n)["x"].alias("bx"), F.get(ring, (i + 1) % n)["y"].alias("by")))


def segment_distance(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / length)))
    gx, gy = px - (e["ax"] + t * dx), py - (e["ay"] + t * dy)
    return F.sqrt(gx * gx + gy * gy)


def _feet(px: Column, py: Column, es: Column) -> Column:
    """Each edge's start and direction, and at which share ``t`` of it the point's foot lies: worked out once, as Spark works out a lambda's expression at each place where it is used."""

    def foot(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / length)))
        return F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), dx.alias("dx"), dy.alias("dy"), t.alias("t"))

    return F.transform(F.transform(es, foot), lambda f: F.struct((f["ax"] + f["t"] * f["dx"]).alias("x"), (f["ay"] + f["t"] * f["dy"]).alias("y")))


def _to(px: Column, py: Column, p: Column) -> Column:
    gx, gy = px - p["x"], py - p["y"]
    return F.sqrt(gx * gx + gy * gy)


def boundary_distance(px: Column, py: Column, es: Column) -> Column:
    return F.array_min(F.transform(_feet(px, py, es), lambda p: _to(px, py, p)))


def inside(px: Column, py: Column, es: Column) -> Column:
    """Half-open ray casting (even-odd)."""
    crossed = F.filter(es, lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.when(e["by"] == e["ay"], F.lit(1.0)).otherwise(e["by"] - e["ay"]) + e["ax"]))
    return F.size(crossed) % 2 == 1


def covers(px: Column, py: Column, es: Column) -> Column:
    return inside(px, py, es) | (boundary_distance(px, py, es) <= TOUCH)


def strictly_inside(px: Column, py: Column, es: Column) -> Column:
    return inside(px, py, es) & (boundary_distance(px, py, es) > TOUCH)


def distance(px: Column, py: Column, es: Column) -> Column:
    return F.when(inside(px, py, es), F.lit(0.0)).otherwise(boundary_distance(px, py, es))


def nearest_on_edges(px: Column, py: Column, es: Column) -> Column:
    """struct<d, x, y>: the nearest point of all edges, and how far away it is."""
    return F.array_min(F.transform(_feet(px, py, es), lambda p: F.struct(_to(px, py, p).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))


def area(ring: Column) -> Column:
    """Shoelace area, never negative."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def centroid_of_vertices(ring: Column) -> Column:
    n = F.size(ring)
    sums = F.aggregate(ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda acc, p: F.struct((acc["x"] + p["x"]).alias("x"), (acc["y"] + p["y"]).alias("y")))
    return F.struct((sums["x"] / n).alias("x"), (sums["y"] / n).alias("y"))


def by_angle(ring: Column) -> Column:
    """Vertices in order of their angle around the mean vertex: for four corners stored row by row."""
    c = centroid_of_vertices(ring)
    keyed = F.transform(ring, lambda p, i: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def corner_order(ring: Column) -> Column:
    """Top left, top right, bottom left, bottom right to a walk around the rectangle."""
    return F.array(ring[0], ring[1], ring[3], ring[2])


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
