"""Spatial lookups of points in zones and sub-zones.

The zones of a floor are one row with an array, joined to the points by floor: a point is looked up
in its own row, without a shuffle of points and without a group for each point. A layout is a small
dimension; its size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULTS, UNKNOWN, Settings
from ..functions import geometry as g

#: A layout with more text than this is joined by a shuffle on the floor.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, written out, have at most ``limit`` bytes; Spark adds them up."""
    size = df.select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("n")).agg(F.sum("n")).first()[0]
    return (size or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, limit) else df


def prepared_zones(zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row a floor: floor_seq, zones array<struct<zone_seq, zone, no_go, edges, buffer, box>> in file order."""
    usable = zones.filter(F.size("ring") >= 3)
    legacy = ~F.col("poly") & (F.size("ring") == 4)
    usable = usable.withColumn("ring", F.when(legacy, g.by_angle(F.col("ring"))).otherwise(F.col("ring")))
    b = g.bounds(F.col("ring"))
    side = (b["maxx"] - b["minx"] + b["maxy"] - b["miny"]) / 2
    row = F.struct("zone_seq", "zone", F.coalesce("no_go", F.lit(False)).alias("no_go"), g.edges(F.col("ring")).alias("edges"), (side * s.zone_buffer).alias("buffer"), b.alias("box"))
    return usable.groupBy("floor_seq").agg(F.sort_array(F.collect_list(row)).alias("zones"))


def allowed(zs: Column) -> Column:
    return F.filter(zs, lambda z: ~z["no_go"])


def _boxed(px: Column, py: Column, z: Column, room: Column | float = 0.0) -> Column:
    """Bounding-box test before the exact one."""
    b = z["box"]
    return px.between(b["minx"] - room, b["maxx"] + room) & py.between(b["miny"] - room, b["maxy"] + room)


def covered_by(px: Column, py: Column, z: Column) -> Column:
    return F.when(_boxed(px, py, z, g.TOUCH), g.covers(px, py, z["edges"])).otherwise(False)


def zone_at(px: Column, py: Column, zs: Column) -> Column:
    """First zone in file order that covers the point, else the one whose boundary is nearest among those within their buffer."""
    first = F.get(F.filter(allowed(zs), lambda z: covered_by(px, py, z)), F.lit(0))["zone"]
    near = F.filter(allowed(zs), lambda z: F.when(_boxed(px, py, z, z["buffer"]), g.boundary_distance(px, py, z["edges"]) < z["buffer"]).otherwise(False))
    soft = F.array_min(F.transform(near, lambda z: F.struct(g.boundary_distance(px, py, z["edges"]).alias("d"), z["zone"].alias("zone"))))["zone"]
    return F.coalesce(first, soft, F.lit(UNKNOWN))


def nearest_zone(px: Column, py: Column, zs: Column) -> Column:
    """The allowed zone at the least distance, the first in file order of several; only points off all zones are measured against each."""
    at = F.get(F.filter(allowed(zs), lambda z: F.when(_boxed(px, py, z, g.TOUCH), g.distance(px, py, z["edges"]) == 0).otherwise(False)), F.lit(0))["zone"]
    ranked = F.transform(allowed(zs), lambda z: F.struct(g.distance(px, py, z["edges"]).alias("d"), z["zone_seq"].alias("zone_seq"), z["zone"].alias("zone")))
    return F.coalesce(at, F.array_min(ranked)["zone"], F.lit(UNKNOWN))


def in_no_go(px: Column, py: Column, zs: Column) -> Column:
    """Strictly inside a forbidden zone; on its edge is outside."""
    return F.coalesce(F.exists(zs, lambda z: F.when(z["no_go"] & _boxed(px, py, z), g.strictly_inside(px, py, z["edges"])).otherwise(False)), F.lit(False))


def snap_plain(px: Column, py: Column, zs: Column) -> Column:
    """struct<x, y>: the nearest point of the allowed zones; the point itself where it is covered or there is no zone.

    For floors without forbidden zones: the nearest point of a union is the nearest of its members'.
    """
    covered = F.exists(allowed(zs), lambda z: covered_by(px, py, z))
    all_edges = F.flatten(F.transform(allowed(zs), lambda z: z["edges"]))
    nearest = g.nearest_on_edges(px, py, all_edges)
    own = F.struct(px.alias("x"), py.alias("y"))
    return F.when(covered | (F.size(all_edges) == 0), own).otherwise(F.struct(nearest["x"].alias("x"), nearest["y"].alias("y")))


def locate(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` (with floor_seq) and zone, nearest_zone, no_go."""
    px, py, zs = F.col(x), F.col(y), F.col("__zones")
    none = F.expr("filter(__zones, z -> false)")
    joined = points.join(small(prepared_zones(zones)).withColumnRenamed("zones", "__zones"), "floor_seq", "left")
    joined = joined.withColumn("__zones", F.coalesce(zs, none))
    known = F.col("__zones").isNotNull()
    return joined.select(
        *points.columns,
        F.when(known, zone_at(px, py, zs)).otherwise(UNKNOWN).alias("zone"),
        F.when(known, nearest_zone(px, py, zs)).otherwise(UNKNOWN).alias("nearest_zone"),
        F.when(known, in_no_go(px, py, zs)).otherwise(False).alias("no_go"),
    )


def prepared_subzones(subzones: DataFrame, zones: DataFrame) -> DataFrame:
    """One row a floor: subzones array in file order, the parent's name looked up by zone id."""
    names = zones.select("floor_seq", F.coalesce("zone_id", "zone").alias("parent"), F.col("zone").alias("parent_zone")).groupBy("floor_seq", "parent").agg(F.last("parent_zone").alias("parent_zone"))
    named = subzones.filter(F.size("ring") >= 3).join(names, ["floor_seq", "parent"], "left")
    row = F.struct("sub_seq", "sub_zone", F.coalesce("parent_zone", "parent").alias("parent"), g.edges(F.col("ring")).alias("edges"), g.bounds(F.col("ring")).alias("box"))
    return named.groupBy("floor_seq").agg(F.sort_array(F.collect_list(row)).alias("__subs"))


def locate_subzone(points: DataFrame, subzones: DataFrame, zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` and sub_zone, sub_parent: strict, no buffer, boundary included."""
    joined = points.join(small(prepared_subzones(subzones, zones)), "floor_seq", "left")
    hit = F.get(F.filter("__subs", lambda z: covered_by(F.col(x), F.col(y), z)), F.lit(0))
    return joined.select(*points.columns, F.coalesce(hit["sub_zone"], F.lit(UNKNOWN)).alias("sub_zone"), hit["parent"].alias("sub_parent"))


def group_receivers(receivers: DataFrame, zones: DataFrame) -> DataFrame:
    """Each receiver under the first zone whose ring contains it (half-open), else the floor's unzoned group."""
    rings = zones.filter(F.size("ring") >= 3).withColumn("ring", F.when(~F.col("poly") & (F.size("ring") == 4), g.corner_order(F.col("ring"))).otherwise(F.col("ring")))
    per_floor = rings.groupBy("floor_seq").agg(F.sort_array(F.collect_list(F.struct("zone_seq", "zone", g.edges(F.col("ring")).alias("edges")))).alias("__zones"))
    hit = F.get(F.filter("__zones", lambda z: g.inside(F.col("x"), F.col("y"), z["edges"])), F.lit(0))["zone"]
    return receivers.join(small(per_floor), "floor_seq", "left").select(*receivers.columns, F.coalesce(hit, F.concat(F.lit("__unzoned__::"), "floor")).alias("zone_group"))
