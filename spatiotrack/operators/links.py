"""Links between receivers from a calibration matrix: merged, coloured, thinned to the nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..functions import scalars as f
from .zones import small


def receiver_links(matrix: DataFrame, receivers: DataFrame, raw: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """floor, a, b, true_m, detected, worst, live_m, stale, hue, band: both directions of a pair in one row."""
    ends = receivers.select("scanner", "x", "y", "height", "scale")
    value = F.col("measured_m" if raw else "corrected_m")
    share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / F.col("true_m") - 1))
    rows = matrix.filter((F.col("true_m") > 0) & value.isNotNull()).select("floor", F.least("tx", "rx").alias("a"), F.greatest("tx", "rx").alias("b"), "tx", "true_m", value.alias("v"), share.alias("p"))
    merged = rows.groupBy("floor", "a", "b").agg(F.min_by("true_m", "tx").alias("true_m"), F.avg("v").alias("detected"), F.max_by("p", F.struct(F.abs("p"), F.when(F.col("tx") == F.col("a"), 1).otherwise(0))).alias("worst"))
    a = small(ends.select(F.col("scanner").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height").alias("ah"), "scale"))
    b = small(ends.select(F.col("scanner").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height").alias("bh")))
    j = merged.join(a, "a").join(b, "b")
    dx, dy = (F.col("ax") - F.col("bx")) / F.col("scale"), (F.col("ay") - F.col("by")) / F.col("scale")
    dh = F.coalesce(F.col("ah") - F.col("bh"), F.lit(0.0))
    j = j.withColumn("live_m", F.when(F.col("scale") > 0, F.sqrt(dx * dx + dy * dy + dh * dh)))
    stale = F.coalesce(F.abs(F.col("live_m") - F.col("true_m")) > F.greatest(F.lit(s.stale_least_m), s.stale_share * F.col("true_m")), F.lit(False))
    j = j.withColumn("stale", stale).withColumn("hue", f.error_hue(F.col("worst")))
    return j.select("floor", "a", "b", "true_m", "detected", "worst", "live_m", "stale", "hue", f.error_band(F.col("hue"), F.col("stale")).alias("band"))


def nearest_links(links: DataFrame, k: int) -> DataFrame:
    """Links that are among the ``k`` nearest of either end."""
    length = F.coalesce("live_m", "true_m")
    ends = links.select("floor", "a", "b", length.alias("__l"), F.explode(F.array("a", "b")).alias("__end"))
    w = Window.partitionBy("floor", "__end").orderBy("__l", "a", "b")
    keep = ends.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).select("floor", "a", "b").distinct()
    return links.join(keep, ["floor", "a", "b"], "left_semi")
