"""Single folds over ordered rows, for use apart from the whole chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from .tracking import Track, elect, smooth


def _ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def elect_floors(scores: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Election over (device, tick, floor_seq, conf): floor_seq (null: nothing published) and probs map<int, double>.

    A column ``valid`` array<int>, if there is one, holds the floors of the layout at that tick: a
    device whose floor was renamed or deleted starts anew, and other floors lose what they had.
    """
    known = "valid" in scores.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, tick, track, now, valid = None, None, Track(), {}, None
        block: list[tuple] = []

        def close() -> None:
            if now:
                floor = elect(track, {k: c for k, c in now.items() if valid is None or k in valid}, valid, s)
                block.append((device, tick, floor, dict(track.probs)))

        for b in batches:
            for d, t, k, c, *floors in b[columns].itertuples(index=False, name=None):
                if d != device or t != tick:
                    close()
                    if d != device:
                        track = Track()
                    device, tick, now = d, t, {}
                    valid = set(floors[0]) if floors and floors[0] is not None else None
                now[k] = c
            yield pd.DataFrame(block, columns=["device", "tick", "floor_seq", "probs"]).astype({"floor_seq": "Int32"})
            block = []
        close()
        yield pd.DataFrame(block, columns=["device", "tick", "floor_seq", "probs"]).astype({"floor_seq": "Int32"})

    columns = ["device", "tick", "floor_seq", "conf", *(["valid"] if known else [])]
    rows = _ordered(scores.select(*columns), "device", "tick", "floor_seq")
    return rows.mapInPandas(run, "device string, tick int, floor_seq int, probs map<int, double>")


def smooth_fixes(fixes: DataFrame, scale: float, s: Settings = DEFAULTS) -> DataFrame:
    """Filtered positions of (ent, updated, event_id, floor_seq, zx, zy), numbered per ent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ent, track, n = None, Track(), 0
        for b in batches:
            out = []
            for e, t, floor, zx, zy in b[["ent", "updated", "floor_seq", "zx", "zy"]].itertuples(index=False, name=None):
                if e != ent:
                    ent, track, n = e, Track(), 0
                n += 1
                x, y = smooth(track, floor, t, zx, zy, scale, s)
                out.append((e, n, floor, x, y))
            yield pd.DataFrame(out, columns=["ent", "n", "floor_seq", "x", "y"])

    rows = _ordered(fixes.select("ent", "updated", "event_id", "floor_seq", "zx", "zy"), "ent", "updated", "event_id")
    return rows.mapInPandas(run, "ent string, n int, floor_seq int, x double, y double")


def trace(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Trace of (ent, seq, x, y, floor): a point stays unless it is under a pixel from the last kept one on its floor; the newest ``trace_points`` per ent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ent, last = None, None
        for b in batches:
            keep = []
            for e, x, y, floor in b[["ent", "x", "y", "floor"]].itertuples(index=False, name=None):
                if e != ent:
                    ent, last = e, None
                far = last is None or last[2] != floor or (x - last[0]) ** 2 + (y - last[1]) ** 2 >= s.trace_step_px**2
                if far:
                    last = (x, y, floor)
                keep.append(far)
            yield b[keep]

    from pyspark.sql import Window

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in points.schema)
    kept = _ordered(points, "ent", "seq").mapInPandas(run, kinds)
    newest = F.row_number().over(Window.partitionBy("ent").orderBy(F.desc("seq")))
    return kept.withColumn("__n", newest).filter(F.col("__n") <= s.trace_points).drop("__n")
