"""The tracking chain on a stream: the same election and smoothing, with state kept per device.

Ranges are computed by the batch functions, which hold no state. The keyed processor solves all
floors of all new ticks of a device at once, then folds tick by tick through the same ``step`` as
the batch chain. A tick that comes at or behind the last one folded, late but inside the watermark, is
dropped: the fold cannot be undone, and the newer fix is out. A device that publishes nothing for
``stale_s`` of event time is pruned by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import DEFAULTS, UNKNOWN, Settings
from ..functions import scalars as f
from ..operators.snapping import Region
from ..operators.solver import trilaterate
from ..operators.tracking import Track, step

OUT = "device string, tick int, floor_seq int, x double, y double, raw_x double, raw_y double, rms_m double, conf double, pruned boolean"
STATE = "track string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def dump(t: Track, last: dict) -> str:
    return json.dumps([{str(k): v for k, v in t.probs.items()}, t.incumbent, t.rival, t.rival_count, t.dark, t.kalman, t.updated, [[*k, v] for k, v in last.items()], t.tick])


def load(text: str) -> tuple[Track, dict]:
    probs, incumbent, rival, count, dark, kalman, updated, last, tick = json.loads(text)
    return Track({int(k): v for k, v in probs.items()}, incumbent, rival, count, dark, kalman, updated, tick), {tuple(v[:3]): v[3] for v in last}


def advance(track: Track, last: dict, rows: pd.DataFrame, boxes: dict, dead: dict, s: Settings = DEFAULTS, floors: set[int] | None = None) -> tuple[list[tuple], dict]:
    """Fixes of one device's new rows (tick, floor_seq, rec_seq, x, y, r, slant, scale), in order of tick."""
    problems, spans = [], []
    for tick, at in rows.groupby("tick", sort=True):
        spans.append((tick, len(problems)))
        seen = {}
        for floor, q in at.sort_values(["floor_seq", "rec_seq"]).groupby("floor_seq", sort=True):
            scale = float(q["scale"].iloc[0])
            least = scale * s.min_weight_radius_m if scale else 1e-3
            before = np.array([last.get((floor, x, y), np.nan) for x, y in zip(q["x"], q["y"], strict=True)])
            a, b = np.maximum(q["r"].to_numpy(), least), np.maximum(before, least)
            rel = (np.fmax(a / b, b / a) - 1) / s.jump_tolerance
            w = np.where(np.isnan(before), 1.0, 1 / (1 + rel * rel))
            seen.update({(floor, x, y): r for x, y, r in zip(q["x"], q["y"], q["r"], strict=True)})
            if len(q) >= 3:
                problems.append((floor, float(q["slant"].min()), q["x"].to_numpy(), q["y"].to_numpy(), q["r"].to_numpy(), w, scale, least))
        last = seen
    n, k = len(problems), max((len(p[2]) for p in problems), default=1)
    data, bounds, least = np.zeros((4, n, k)), np.zeros((n, 4)), np.zeros(n)
    for i, (floor, _, x, y, r, w, _, small) in enumerate(problems):
        data[:, i, : len(x)] = x, y, r, np.maximum(w, 1e-12)
        zx0, zy0, zx1, zy1 = boxes.get(floor, (np.inf, np.inf, -np.inf, -np.inf))
        x0, y0, x1, y1 = min(x.min(), zx0), min(y.min(), zy0), max(x.max(), zx1), max(y.max(), zy1)
        m = s.bounds_margin * max(x1 - x0, y1 - y0, 1.0)
        bounds[i], least[i] = (x0 - m, y0 - m, x1 + m, y1 + m), small
    fixes = trilaterate(*data, bounds[:, :2], bounds[:, 2:], least) if n else np.zeros((0, 2))
    ends = [a for _, a in spans[1:]] + [n]
    out = []
    for (tick, a), b in zip(spans, ends, strict=True):
        ranked = sorted(range(a, b), key=lambda i: (problems[i][1], problems[i][0]))
        solved = {}
        for rank, i in enumerate(ranked, 1):
            floor, _, x, y, r, w, scale, _ = problems[i]
            fx, fy = fixes[i]
            e = np.hypot(x - fx, y - fy) - r
            rms = np.sqrt((w * e * e).sum() / w.sum()) * np.sqrt(len(x) / max(len(x) - 2.0, 1.0)) / (scale if scale > 0 else 1.0)
            conf = 0.5 * min(1.0, len(x) / s.coverage_n) + 0.5 / (1 + (rms / s.residual_scale_m) ** 2)
            if any(bool(Region._inside(np.array([[fx, fy]]), ring)[0]) and Region._distance(np.array([[fx, fy]]), ring).min() > 1e-9 for ring in dead.get(floor, ())):
                conf *= s.no_go_penalty
            solved[floor] = (rank, fx, fy, float(rms), float(conf), scale, *bounds[i])
        if solved and (fix := step(track, int(tick), solved, s, floors)):
            out.append((int(tick), *fix[:-1]))
    return out, last


def processor(boxes: dict, dead: dict, s: Settings = DEFAULTS, floors: set[int] | None = None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        device = key[0]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(device, None, None, None, None, None, None, None, None, True)], columns=NAMES)
            return
        track, last = load(state.get[0]) if state.exists else (Track(), {})
        rows = pd.concat(list(batches))
        if track.tick is not None:
            rows = rows[rows["tick"] > track.tick]
        if len(rows):
            fixes, last = advance(track, last, rows, boxes, dead, s, floors)
            track.tick = int(rows["tick"].max())
        else:
            fixes = []
        state.update((dump(track, last),))
        seen = track.updated if track.updated is not None else track.tick * s.tick_s
        state.setTimeoutTimestamp(max(int((seen + s.stale_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(device, *fix, False) for fix in fixes], columns=NAMES)

    return run


def zone_frames(zones: DataFrame) -> tuple[dict, dict]:
    """Bounding boxes of all zones and edges of the forbidden ones, per floor; a layout is small."""
    from ..operators.zones import prepared_zones

    boxes, dead = {}, {}
    for floor, zs in prepared_zones(zones).collect():
        b = [z["box"] for z in zs]
        boxes[floor] = min(v["minx"] for v in b), min(v["miny"] for v in b), max(v["maxx"] for v in b), max(v["maxy"] for v in b)
        dead[floor] = [np.array([[e["ax"], e["ay"], e["bx"], e["by"]] for e in z["edges"]]) for z in zs if z["no_go"]]
    return boxes, dead


def track_stream(readings: DataFrame, zones: DataFrame, s: Settings = DEFAULTS, late: str = "30 seconds", floors: set[int] | None = None) -> DataFrame:
    """Fixes of a stream of readings (device, tick, ts, floor_seq, rec_seq, x, y, r, slant, scale); pruned devices give a row too.

    ``floors``: those of today's layout; a query restarted with another layout makes devices on
    floors that are gone start anew.
    """
    boxes, dead = zone_frames(zones)
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("device").applyInPandasWithState(processor(boxes, dead, s, floors), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(states: DataFrame, forget: str | None = None) -> DataFrame:
    """The first appearance of each distance sensor on a stream.

    State is one id for each sensor that there is. Where sensors come and go for ever, ``forget`` (a
    delay of the watermark on ``ts``) bounds it: a sensor counts as new again after that time.
    """
    own = states.filter(F.col("entity_id").contains("_distance_to_"))
    once = own.dropDuplicates(["entity_id"]) if forget is None else own.withWatermark("ts", forget).dropDuplicatesWithinWatermark(["entity_id"])
    return once.select("entity_id", f.device_of(F.col("entity_id")).alias("device"))


def recorder(fixes: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Fixes of a stream without repeats of (ent, updated)."""
    return fixes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ent", "updated"])


def flap_windows(fixes: DataFrame, width: str = "60 seconds", late: str = "30 seconds") -> DataFrame:
    """Fixes and different floors of each tracker in tumbling windows of event time."""
    w = fixes.withWatermark("ts", late).groupBy("ent", F.window("ts", width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.collect_set("floor").alias("floors")).select("ent", F.col("w.start").alias("start"), "n", F.size("floors").alias("floors"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is available now and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unknown_states(pruned: DataFrame) -> DataFrame:
    """Sensor states of pruned devices."""
    kinds = F.array(*[F.concat(F.lit("sensor."), "device", F.lit(k)) for k in ("_bps_zone", "_bps_floor", "_bps_nearest_zone", "_bps_sub_zone")])
    return pruned.filter("pruned").select(F.explode(kinds).alias("entity_id"), F.lit(UNKNOWN).alias("state"))
