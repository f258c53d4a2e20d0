"""Latest fixes, published sensor states, their lifecycle, and pruning of stale trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, UNKNOWN, Settings

KINDS = ("bps_zone", "bps_floor", "bps_nearest_zone", "bps_sub_zone")
ACCURACY_ID = "sensor.bps_positioning_accuracy"


def latest_fixes(fixes: DataFrame) -> DataFrame:
    """The newest fix of each tracker: an aggregation, so a busy tracker is combined before the shuffle."""
    cols = [c for c in fixes.columns if c not in ("ent", "updated")]
    best = fixes.groupBy("ent").agg(F.max_by(F.struct(*cols), F.struct("updated", "event_id")).alias("__r"), F.max("updated").alias("updated"))
    return best.select("ent", "updated", *[F.col("__r")[c].alias(c) for c in cols])


def sensor_states(fixes: DataFrame) -> DataFrame:
    """entity_id, state, parent_zone: four sensors a fix (ent, zone, floor, nearest_zone, sub_zone, parent_zone)."""
    rows = F.array(*[F.struct(F.concat(F.lit("sensor."), "ent", F.lit(f"_{kind}")).alias("entity_id"), F.col(kind[4:]).alias("state"), (F.col("parent_zone") if kind == "bps_sub_zone" else F.lit(None).cast("string")).alias("parent_zone")) for kind in KINDS])
    return fixes.select(F.inline(rows))


def publish_known(states: DataFrame, known: DataFrame) -> DataFrame:
    """States of sensors that exist; others are dropped."""
    return states.join(known.select("entity_id"), "entity_id", "left_semi")


def expected_sensors(devices: DataFrame) -> DataFrame:
    return devices.select(F.explode(F.array(*[F.concat(F.lit("sensor."), "device", F.lit(f"_{k}")) for k in KINDS])).alias("entity_id"))


def missing_sensors(devices: DataFrame, existing: DataFrame) -> DataFrame:
    return expected_sensors(devices).distinct().join(existing.select("entity_id"), "entity_id", "left_anti")


def stale_sensors(registry: DataFrame, devices: DataFrame) -> DataFrame:
    """Registered sensors that are not expected, but for the accuracy sensor; none at all when nothing is expected."""
    wanted = expected_sensors(devices).distinct()
    some = wanted.limit(1).select(F.lit(True).alias("__some"))
    return registry.filter(F.col("entity_id") != ACCURACY_ID).join(wanted, "entity_id", "left_anti").join(F.broadcast(some), how="cross").drop("__some")


def stale_trackers(latest: DataFrame, now: Column, timeout: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Trackers whose last fix is older than the timeout; one without ``updated`` never is."""
    limit = timeout if timeout and timeout > 0 else s.stale_s
    return latest.filter(now - F.coalesce(F.col("updated"), now) > limit).select("ent", "updated")


def cleared_states(stale: DataFrame) -> DataFrame:
    """What is published for a pruned tracker."""
    gone = stale.select("ent", *[F.lit(UNKNOWN).alias(c) for c in ("zone", "floor", "nearest_zone", "sub_zone", "parent_zone")])
    return sensor_states(gone)


def visits(fixes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Stretches of fixes (ent, updated) without a gap over the timeout: ent, visit, start, end, n."""
    w = Window.partitionBy("ent").orderBy("updated", "event_id")
    cut = F.when(F.col("updated") - F.lag("updated").over(w) > s.stale_s, 1).otherwise(0)
    rows = fixes.withColumn("__cut", cut).withColumn("visit", F.sum("__cut").over(w))
    return rows.groupBy("ent", "visit").agg(F.min("updated").alias("start"), F.max("updated").alias("end"), F.count(F.lit(1)).alias("n"))


def out_of_range(devices: DataFrame, candidates: DataFrame) -> DataFrame:
    """Devices without any candidate floor: only their nearest zone becomes unknown."""
    return devices.join(candidates.select("device").distinct(), "device", "left_anti").select(F.concat(F.lit("sensor."), "device", F.lit("_bps_nearest_zone")).alias("entity_id"), F.lit(UNKNOWN).alias("state"))


def followed(fixes: DataFrame, tracked: DataFrame, shown: str) -> DataFrame:
    """Fixes of followed devices, flagged where they are on another floor than the one shown."""
    off = ~F.coalesce(F.lower(F.trim("floor")) == shown.strip().lower(), F.lit(True))
    return fixes.join(tracked.select("ent"), "ent", "left_semi").withColumn("off_floor", off)


def on_floor_counts(fixes: DataFrame, floor_states: DataFrame) -> DataFrame:
    """Per card floor: trackers shown on it, of all with a floor state. floor_states: ent, floor, card_floor."""
    j = fixes.select("ent").distinct().join(floor_states, "ent")
    return j.groupBy("card_floor").agg(F.count_if(F.lower(F.trim("floor")) == F.lower(F.trim("card_floor"))).alias("shown"), F.count(F.lit(1)).alias("total"))
