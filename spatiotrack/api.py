"""Entry points by task, over Spark tables. Nothing here computes on its own."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import DEFAULTS, Settings
from .operators import adjust, calibration, diagnostics, evaluation, publishing, tracking
from .operators.solver import trilaterate
from .sources import files


class Layout:
    """A layout document as tables."""

    def __init__(self, document: DataFrame):
        self.document = document
        self.floors, self.receivers = files.floors(document), files.receivers(document)
        self.zones, self.subzones = files.zones(document), files.subzones(document)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Layout:
        return cls(files.read_layout(spark, path))

    def save(self, path: str) -> None:
        files.save_layout(self.document, path)

    def tracker_height(self) -> float | None:
        row = self.document.select("tracker_height").first()
        return row[0] if row else None

    def position_timeout(self) -> float | None:
        row = self.document.select("position_timeout").first()
        return row[0] if row else None


def track(states: DataFrame, layout: Layout, s: Settings = DEFAULTS) -> DataFrame:
    return tracking.track(states, layout.receivers, layout.zones, layout.subzones, layout.tracker_height(), s)


def latest_fixes(fixes: DataFrame) -> DataFrame:
    return publishing.latest_fixes(fixes)


def layout_overview(layout: Layout, sensors: DataFrame) -> dict[str, DataFrame]:
    return {
        "floors": layout.floors,
        "unmatched": diagnostics.unmatched_placements(layout.receivers, sensors),
        "unplaced": diagnostics.unplaced_scanners(sensors, layout.receivers),
        "devices": sensors.select("device").distinct(),
    }


def scanner_linking(layout: Layout, sensors: DataFrame) -> DataFrame:
    return diagnostics.problem_order(diagnostics.scanner_linking(layout.receivers.select("floor", "scanner", "uid"), sensors))


def beacon_links(sensors: DataFrame) -> DataFrame:
    return diagnostics.beacon_links(sensors)


def offline_receivers(status: DataFrame) -> DataFrame:
    return status.filter(~F.col("online")).select("scanner")


def adjust_zones(layout: Layout, options: dict | None = None) -> DataFrame:
    return adjust.adjust_zones(layout.zones, options)


def adjust_subzones(layout: Layout, options: dict | None = None) -> DataFrame:
    return adjust.adjust_subzones(layout.zones, layout.subzones, options)


def selftest(samples: DataFrame, layout: Layout) -> DataFrame:
    return calibration.selftest(samples, files.selftest_receivers(layout.document), layout.zones)


def score_recording(spark: SparkSession, path: str, **how) -> DataFrame:
    samples, scales = evaluation.read_recording(spark, path)
    return evaluation.score(samples.withColumn("seq", F.monotonically_increasing_id()), scales, **how)


def compare(now: DataFrame, baseline: DataFrame) -> DataFrame:
    return evaluation.compare(now, baseline)


class Calibration:
    """Samples in, corrections out; nothing is held but table references."""

    def __init__(self, samples: DataFrame, receivers: DataFrame, s: Settings = DEFAULTS):
        self.receivers, self.settings = receivers, s
        self.samples = calibration.rolling_window(samples, s.window)
        self.pairs = calibration.usable_pairs(self.samples, receivers, s)

    def solve(self) -> DataFrame:
        return calibration.corrections(calibration.calibrate(self.pairs, self.settings), self.pairs, self.settings)

    def report(self) -> DataFrame:
        return calibration.matrix(self.pairs, self.solve())

    def apply(self, floor: Column | None = None) -> DataFrame:
        return calibration.apply_corrections(self.receivers, self.solve(), floor)

    def reset(self) -> DataFrame:
        return calibration.reset_corrections(self.receivers)

    def persist(self) -> DataFrame:
        return calibration.rolling_window(self.samples, self.settings.persisted)


def register(spark: SparkSession) -> None:
    """SQL-callable functions: trilaterate(points, min_radius), polygon_edges(ring), layout_receivers(json)."""
    def fix(points: pd.Series, least: pd.Series) -> pd.DataFrame:
        n, k = len(points), max((len(p) for p in points), default=1)
        data = np.zeros((4, n, k))
        for i, p in enumerate(points):
            for j, v in enumerate(p):
                data[:, i, j] = v["x"], v["y"], v["r"], 1.0
        box = np.full((n, 2), np.inf)
        out = trilaterate(*data, -box, box, least.to_numpy(float))
        out[[len(p) < 3 for p in points]] = np.nan
        return pd.DataFrame(out, columns=["x", "y"])

    spark.udf.register("trilaterate", F.pandas_udf(fix, "x double, y double"))

    @F.udtf(returnType="ax double, ay double, bx double, by double")
    class PolygonEdges:
        def eval(self, ring):
            for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True):
                yield a["x"], a["y"], b["x"], b["y"]

    @F.udtf(returnType="floor string, scanner string, x double, y double")
    class LayoutReceivers:
        def eval(self, text):
            try:
                floors = json.loads(text)["floor"]
            except (TypeError, ValueError, KeyError):
                return
            for floor in floors:
                for r in floor.get("receivers") or []:
                    if r.get("entity_id"):
                        at = r.get("cords") or {}
                        yield floor.get("name"), r["entity_id"], at.get("x"), at.get("y")

    spark.udtf.register("polygon_edges", PolygonEdges)
    spark.udtf.register("layout_receivers", LayoutReceivers)
