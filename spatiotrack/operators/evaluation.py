"""Offline quality metrics of recorded fixes: steps, CEP, bias, cross-track error, flaps.

Percentiles are exact with linear interpolation. Distances that need a group's centre use a window
average, so one shuffle by tracker serves centre and percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import updated_or_zero

RECORD = "type string, started double, scales map<string,double>, ent string, updated string, cords array<double>, raw array<double>, floor string, zone string, rms_m double, conf double, __broken string"


def read_recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, scales) of JSON lines: a header with scales per floor, samples with ``ent``; broken lines and samples without one are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r")).select("r.*").filter("__broken is null")
    scales = rows.filter("type = 'header'").select(F.explode("scales").alias("floor", "scale"))
    samples = rows.filter("coalesce(type, '') <> 'header' and ent is not null")
    at = lambda c, i: F.get(c, F.lit(i))
    out = samples.select("ent", updated_or_zero(F.col("updated")).alias("updated"), at("cords", 0).alias("x"), at("cords", 1).alias("y"), at("raw", 0).alias("raw_x"), at("raw", 1).alias("raw_y"), "floor", "zone", "rms_m", "conf")
    return out, scales


def usable_scales(floors: DataFrame) -> DataFrame:
    return floors.filter(F.col("scale") > 0).select("floor", "scale")


def main_floor(samples: DataFrame) -> DataFrame:
    """ent, main_floor: the most frequent floor, of equals the one seen first."""
    n = samples.groupBy("ent", "floor").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("updated", "seq")).alias("first"))
    w = Window.partitionBy("ent").orderBy(F.desc("n"), "first")
    return n.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("ent", F.col("floor").alias("main_floor"))


def flaps(samples: DataFrame) -> DataFrame:
    """ent, n, duration_s, floor_flaps, zone_flaps, rms_m_mean, conf_mean; a change to or from null is a flap."""
    w = Window.partitionBy("ent").orderBy("updated", "seq")
    changed = lambda c: F.when(F.row_number().over(w) > 1, ~F.col(c).eqNullSafe(F.lag(c).over(w))).otherwise(False).cast("int")
    rows = samples.withColumn("__f", changed("floor")).withColumn("__z", changed("zone"))
    return rows.groupBy("ent").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("updated") - F.min("updated"), 1).alias("duration_s"), F.sum("__f").alias("floor_flaps"), F.sum("__z").alias("zone_flaps"),
        F.round(F.avg("rms_m"), 3).alias("rms_m_mean"), F.round(F.avg("conf"), 3).alias("conf_mean"),
    )


def steps(samples: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Step lengths in pixels between neighbouring samples with a position on the same floor."""
    w = Window.partitionBy("ent").orderBy("updated", "seq")
    rows = samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return rows.select("ent", "updated", "seq", F.when(F.col("floor").eqNullSafe(F.lag("floor").over(w)) & (F.row_number().over(w) > 1), F.sqrt(dx * dx + dy * dy)).alias("step")).filter("step is not null")


def step_metrics(samples: DataFrame, scale: Column, x: str = "x", y: str = "y") -> DataFrame:
    s = steps(samples, x, y).withColumn("step", F.col("step") / scale)
    return s.groupBy("ent").agg(F.percentile("step", F.lit(0.5)).alias("step_median"), F.percentile("step", F.lit(0.95)).alias("step_p95"), F.max("step").alias("step_max"))


def spread_metrics(samples: DataFrame, scale: Column, truth: tuple[float, float] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """CEP about the centroid, and the centroid's bias from a true position."""
    w = Window.partitionBy("ent")
    rows = samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("cx", F.avg(x).over(w)).withColumn("cy", F.avg(y).over(w))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    rows = rows.withColumn("radial", F.sqrt(dx * dx + dy * dy) / scale)
    out = rows.groupBy("ent").agg(F.count(F.lit(1)).alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.percentile("radial", F.lit(0.5)).alias("cep50"), F.percentile("radial", F.lit(0.95)).alias("cep95"))
    if truth is not None:
        ex, ey = F.col("cx") - truth[0], F.col("cy") - truth[1]
        out = out.withColumn("bias", F.sqrt(ex * ex + ey * ey) / scale)
    return out


def crosstrack_metrics(samples: DataFrame, waypoints: list[tuple[float, float]], scale: Column, x: str = "x", y: str = "y") -> DataFrame:
    """RMS and 95th percentile of the distance to a polyline."""
    pairs = list(zip(waypoints[:-1], waypoints[1:], strict=True)) or [(waypoints[0], waypoints[0])]
    segments = F.array(*[F.struct(F.lit(float(a[0])).alias("ax"), F.lit(float(a[1])).alias("ay"), F.lit(float(b[0])).alias("bx"), F.lit(float(b[1])).alias("by")) for a, b in pairs])
    d = g.boundary_distance(F.col(x), F.col(y), segments) / scale
    rows = samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ent", d.alias("d"))
    return rows.groupBy("ent").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("crosstrack_rms"), F.percentile("d", F.lit(0.95)).alias("crosstrack_p95"))


def score(samples: DataFrame, scales: DataFrame, truth: tuple[float, float] | None = None, waypoints: list[tuple[float, float]] | None = None) -> DataFrame:
    """All metrics, a row for each tracker and series (published, raw); the main floor's scale serves all samples."""
    floors = main_floor(samples).join(scales, F.col("main_floor") == F.col("floor"), "left").select("ent", "main_floor", F.coalesce("scale", F.lit(1.0)).alias("px_per_m"))
    rows = samples.join(floors, "ent")
    out = None
    per = F.first("px_per_m").alias("px_per_m")
    head = flaps(samples).join(floors, "ent")
    for series, x, y in (("published", "x", "y"), ("raw", "raw_x", "raw_y")):
        scaled = rows.withColumn(x, F.col(x) / F.col("px_per_m")).withColumn(y, F.col(y) / F.col("px_per_m"))
        m = spread_metrics(scaled, F.lit(1.0), None, x, y).drop("n").join(step_metrics(scaled, F.lit(1.0), x, y), "ent", "left")
        if waypoints or truth:
            known = rows.groupBy("ent").agg(per)
            if truth:
                ex, ey = F.col("cx") - truth[0] / F.col("px_per_m"), F.col("cy") - truth[1] / F.col("px_per_m")
                m = m.join(known, "ent").withColumn("bias", F.sqrt(ex * ex + ey * ey)).drop("px_per_m")
            if waypoints:
                m = m.join(crosstrack_metrics(rows, waypoints, F.col("px_per_m"), x, y), "ent", "left")
        part = head.join(m, "ent", "left").withColumn("series", F.lit(series)).withColumn("units", F.when(F.col("px_per_m") != 1.0, "m").otherwise("px"))
        out = part if out is None else out.unionByName(part)
    return out


METRICS = ("step_median", "step_p95", "step_max", "cep50", "cep95", "bias", "crosstrack_rms", "crosstrack_p95")


def compare(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """ent, series, metric, value, baseline, delta, verdict: lower is better."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        have = [m for m in METRICS if m in df.columns]
        return df.select("ent", "series", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in have])))

    j = tall(now, "value").join(tall(baseline, "baseline"), ["ent", "series", "metric"]).withColumn("delta", F.col("value") - F.col("baseline"))
    return j.withColumn("verdict", F.when(F.col("delta") < 0, "improved").when(F.col("delta") > 0, "worse").otherwise("same"))


def new_samples(samples: DataFrame) -> DataFrame:
    """Samples whose ``updated`` differs from the one before, per tracker."""
    w = Window.partitionBy("ent").orderBy("seq")
    return samples.withColumn("__p", F.lag("updated").over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~F.col("updated").eqNullSafe(F.col("__p"))).drop("__p", "__n")


def trace_segments(points: DataFrame, shown: str) -> DataFrame:
    """Neighbouring points of a trace that both lie on the shown floor (a missing floor counts as shown), with their age bucket."""
    w = Window.partitionBy("ent").orderBy("seq")
    on = F.coalesce(F.lower(F.trim("floor")) == shown.strip().lower(), F.lit(True))
    rows = points.withColumn("__on", on).withColumn("__i", F.row_number().over(w) - 1).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("ent")))
    lag = lambda c: F.lag(c).over(w)
    seg = rows.select("ent", "seq", lag("x").alias("ax"), lag("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("__on") & lag("__on")).alias("__both"), F.least(F.lit(7), F.floor((F.col("__i") - 1) / F.greatest(F.col("__all") - 1, F.lit(1)) * 8).cast("int")).alias("bucket"))
    return seg.filter("__both").drop("__both")
