"""From sensor states to candidate floors: parse, normalise, join, aggregate, weigh, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, DISTANCE_MARK, DISTANCE_PLATFORM, Settings
from ..functions import geometry as g
from ..functions import scalars as f
from .zones import small


def owned_sensors(states: DataFrame, registry: DataFrame, platform: str = DISTANCE_PLATFORM) -> DataFrame:
    """Distance sensors that belong to the platform."""
    own = registry.filter(F.col("platform") == platform).select("entity_id")
    return states.filter(F.col("entity_id").contains(DISTANCE_MARK)).join(own, "entity_id", "left_semi")


def enough_sensors(states: DataFrame, s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """Ticks with fewer sensors than three in all, over all devices, are skipped whole.

    ``tasks``: over how many tasks the sensors of all ticks are dealt out, if not as many as a shuffle
    has. There are few ticks, so states never meet them by a shuffle on the tick while their list is small.
    """
    keys = ["tick", "entity_id"]
    seen = states.select(*keys)
    once = (seen.repartition(tasks, *keys) if tasks else seen).distinct()
    counts = once.groupBy("tick").agg(F.count("entity_id").alias("__n"))
    return states.join(small(counts.filter(F.col("__n") >= s.least_sensors).select("tick")), "tick", "left_semi")


def readings(states: DataFrame, receivers: DataFrame, height: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """One row for each numeric reading of a placed receiver.

    Adds to device, tick and the receiver's columns: metres, slant (corrected), horizontal, r (pixels).
    """
    tracker = f.tracker_height(F.lit(height).cast("double"), s)
    parsed = states.select(*[c for c in states.columns if c not in ("state", "unit")], f.device_of(F.col("entity_id")).alias("device"), f.scanner_of(F.col("entity_id")).alias("scanner"), f.metres(f.number(F.col("state")), F.col("unit")).alias("metres"))
    joined = parsed.filter(F.col("metres").isNotNull()).join(small(receivers.filter(F.col("scale").isNotNull())), "scanner")
    slant = joined.withColumn("slant", f.corrected(F.col("metres"), F.col("correction")))
    flat = slant.withColumn("horizontal", f.horizontal(F.col("slant"), F.col("height"), tracker, s))
    return flat.withColumn("r", F.col("scale") * F.col("horizontal"))


def candidate_floors(rows: DataFrame) -> DataFrame:
    """Per device, tick and floor: nearest slant, number of receivers, their points in placement order."""
    point = F.struct("rec_seq", "x", "y", "r", "slant")
    return rows.groupBy("device", "tick", "floor_seq", "floor", "scale").agg(F.min("slant").alias("nearest_m"), F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list(point)).alias("points"))


def rank_floors(candidates: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Solvable floors by nearest receiver, ties in file order; ``rank`` up to three are solved."""
    w = Window.partitionBy("device", "tick").orderBy("nearest_m", "floor_seq")
    return candidates.filter("n >= 3").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= s.candidates)


def with_pieces(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds ``piece``: the number of earlier gaps of more than ``stale_s`` in the device's history.

    Nothing that a device carries outlives such a gap, so pieces can be worked on apart, and one device's
    history of years is no longer one task's. Gaps are found on blocks of ticks as long as the gap, a
    row for each device and block, added up before any shuffle: inside of a block there can be none.
    Only blocks of devices that have a gap are joined back.
    """
    block = F.floor(F.col("tick") * s.tick_s / s.stale_s)
    blocks = rows.groupBy("device", block.alias("__block")).agg(F.min("tick").alias("__first"), F.max("tick").alias("__last"))
    order = Window.partitionBy("device").orderBy("__block")
    gap = (F.col("__first") - F.lag("__last").over(order)) * s.tick_s > s.stale_s
    cut = blocks.withColumn("__cut", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("piece", F.sum("__cut").over(order).cast("int"))
    cut = cut.withColumn("__pieces", F.max("piece").over(Window.partitionBy("device"))).filter("__pieces > 0").select("device", "__block", "piece")
    joined = rows.withColumn("__block", block).join(small(cut), ["device", "__block"], "left")
    return joined.withColumn("piece", F.coalesce("piece", F.lit(0))).drop("__block")


def history(rows: DataFrame) -> list[str]:
    """The columns whose rows share a memory."""
    return ["device", "piece"] if "piece" in rows.columns else ["device"]


def with_jump_weights(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds previous_r and w. The previous radius counts only if it is from the device's last cycle with candidates, not over ``stale_s`` ago."""
    own = history(rows)
    cycle = F.dense_rank().over(Window.partitionBy(*own).orderBy("tick"))
    rows = rows.withColumn("cycle", cycle)
    # Receivers at one place share a memory: the last one placed wins.
    same = Window.partitionBy(*own, "floor_seq", "x", "y", "cycle")
    rows = rows.withColumn("__kept", F.max(F.struct("rec_seq", "r")).over(same)["r"])
    earlier = Window.partitionBy(*own, "floor_seq", "x", "y").orderBy("cycle").rangeBetween(-1, -1)
    fresh = (F.col("tick") - F.max("tick").over(earlier)) * s.tick_s <= s.stale_s
    rows = rows.withColumn("previous_r", F.when(fresh, F.max("__kept").over(earlier))).drop("__kept")
    return rows.withColumn("w", f.jump_weight(F.col("r"), F.col("previous_r"), f.min_weight_radius(F.col("scale"), s), s))


def floor_bounds(rows: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Solver bounds per device, tick and floor: extent of the receivers used and of the floor's zones, with a margin."""
    b = g.bounds(F.col("ring"))
    boxes = zones.filter(F.size("ring") >= 3).groupBy("floor_seq").agg(F.min(b["minx"]).alias("zx0"), F.min(b["miny"]).alias("zy0"), F.max(b["maxx"]).alias("zx1"), F.max(b["maxy"]).alias("zy1"))
    used = rows.groupBy("device", "tick", "floor_seq").agg(F.min("x").alias("rx0"), F.min("y").alias("ry0"), F.max("x").alias("rx1"), F.max("y").alias("ry1"))
    j = used.join(small(boxes), "floor_seq", "left")
    x0, y0, x1, y1 = F.least("rx0", "zx0"), F.least("ry0", "zy0"), F.greatest("rx1", "zx1"), F.greatest("ry1", "zy1")
    m = s.bounds_margin * F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    return j.select("device", "tick", "floor_seq", (x0 - m).alias("minx"), (y0 - m).alias("miny"), (x1 + m).alias("maxx"), (y1 + m).alias("maxy"))


def fit_score(points: DataFrame, fixes: DataFrame, zones: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """rms_m, coverage and conf of a fix (device, tick, floor_seq, fx, fy) over the floor's weighted readings."""
    j = points.join(fixes, ["device", "tick", "floor_seq"])
    dx, dy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    res = F.sqrt(dx * dx + dy * dy) - F.col("r")
    agg = j.groupBy("device", "tick", "floor_seq", "scale", "fx", "fy").agg(F.sum(F.col("w") * res * res).alias("num"), F.sum("w").alias("den"), F.count(F.lit(1)).alias("n"))
    rms = F.sqrt(F.col("num") / F.col("den")) * F.sqrt(F.col("n") / F.greatest(F.col("n") - 2.0, F.lit(1.0))) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    out = agg.withColumn("rms_m", rms).withColumn("coverage", F.least(F.lit(1.0), F.col("n") / s.coverage_n))
    return out.withColumn("conf", 0.5 * F.col("coverage") + 0.5 * f.fit_quality(F.col("rms_m"), s)).drop("num", "den")
