"""Floor election and position smoothing per device, and the whole tracking chain.

The per-device fold needs its rows in order and nothing else: rows are dealt out by device and
sorted within partitions by Spark (which spills), and one pass carries a small state from batch to
batch. No device's history is ever held in memory. The same state machine runs in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..functions import scalars as f
from . import readings as rd
from . import zones as zn
from .snapping import snap_into_zones
from .solver import solve


@dataclass
class Track:
    """What a device carries from tick to tick."""

    probs: dict = field(default_factory=dict)
    incumbent: int | None = None
    rival: int | None = None
    rival_count: int = 0
    dark: int = 0
    # Both axes share the covariance, so position and velocity of each and three scalars suffice.
    kalman: list | None = None  # floor, time, x, vx, y, vy, p00, p01, p11
    updated: float | None = None
    tick: int | None = None


def elect(t: Track, scores: dict[int, float], valid: set[int] | None = None, s: Settings = DEFAULTS) -> int | None:
    """One cycle of the election; None: nothing is published. Ties go to the lower floor number."""
    if t.incumbent is not None and valid is not None and t.incumbent not in valid:
        t.probs, t.incumbent, t.rival, t.rival_count, t.dark = {}, None, None, 0, 0
    if not scores:
        return None
    if t.incumbent is not None and t.incumbent not in scores and t.incumbent in t.probs:
        if t.dark < s.dark_grace:
            t.dark += 1
            return None
        t.incumbent = None
    t.dark = 0
    total = sum(scores[k] for k in sorted(scores))
    kept = {k: p for k, p in t.probs.items() if valid is None or k in valid}
    moved = {k: s.smoothing * kept.get(k, 0.0) + (1 - s.smoothing) * (scores.get(k, 0.0) / total if total > 0 else 0.0) for k in sorted({*kept, *scores})}
    moved = {k: p for k, p in moved.items() if p >= s.least_probability}
    norm = sum(moved.values())
    t.probs = {k: p / norm for k, p in moved.items()} if norm > 0 else moved
    standing = {k: p for k, p in t.probs.items() if k in scores}
    if not standing:
        t.rival, t.rival_count = None, 0
        return None
    best = max(standing, key=lambda k: (standing[k], -k))
    chosen = t.incumbent
    if t.incumbent is None or t.incumbent not in standing:
        chosen, t.rival, t.rival_count = best, None, 0
    elif best == t.incumbent or standing[best] - standing[t.incumbent] < s.margin:
        t.rival, t.rival_count = None, 0
    else:
        t.rival_count = t.rival_count + 1 if t.rival == best else 1
        t.rival = best
        if t.rival_count >= s.switch_cycles:
            chosen, t.rival, t.rival_count = best, None, 0
    if chosen != t.incumbent:
        t.kalman = None
    t.incumbent = chosen
    return chosen


def smooth(t: Track, floor: int, now: float, x: float, y: float, scale: float, s: Settings = DEFAULTS) -> tuple[float, float]:
    """One step of the constant-velocity filter, not clipped."""
    px = scale if scale and scale > 0 else 1.0
    r, a = (s.kf_meas_m * px) ** 2, (s.kf_accel * px) ** 2
    k = t.kalman
    if k is None or k[0] != floor or now - k[1] > s.kf_max_gap:
        t.kalman = [floor, now, x, 0.0, y, 0.0, r, 0.0, (s.kf_init_vel * px) ** 2]
        return x, y
    dt = min(max(now - k[1], s.kf_min_dt), s.kf_max_dt)
    mx, my = k[2] + dt * k[3], k[4] + dt * k[5]
    p00 = k[6] + 2 * dt * k[7] + dt * dt * k[8] + dt**4 / 4 * a
    p01 = k[7] + dt * k[8] + dt**3 / 2 * a
    p11 = k[8] + dt * dt * a
    g0, g1 = p00 / (p00 + r), p01 / (p00 + r)
    ex, ey = x - mx, y - my
    t.kalman = [floor, now, mx + g0 * ex, k[3] + g1 * ex, my + g0 * ey, k[5] + g1 * ey, (1 - g0) * p00, (1 - g0) * p01, p11 - g1 * p01]
    return t.kalman[2], t.kalman[4]


FIX = "device string, tick int, floor_seq int, x double, y double, raw_x double, raw_y double, rms_m double, conf double, floors map<int, double>"


def step(t: Track, tick: int, solved: dict[int, tuple], s: Settings = DEFAULTS, valid: set[int] | None = None) -> tuple | None:
    """``solved``: floor -> (rank, fx, fy, rms_m, conf, scale, minx, miny, maxx, maxy). The published fix, or None.

    ``valid``: the floors of the layout; a device whose floor is no longer there starts anew.
    """
    now = tick * s.tick_s
    if t.updated is not None and now - t.updated > s.stale_s:
        t.probs, t.incumbent, t.rival, t.rival_count, t.dark, t.kalman, t.updated = {}, None, None, 0, 0, None, None
    running = {k: v for k, v in solved.items() if v[0] <= s.candidates or k == t.incumbent}
    floor = elect(t, {k: v[4] for k, v in running.items()}, valid, s)
    if floor is None:
        return None
    _, fx, fy, rms, conf, scale, x0, y0, x1, y1 = running[floor]
    x, y = smooth(t, floor, now, fx, fy, scale, s)
    t.updated = now
    return floor, min(max(x, x0), x1), min(max(y, y0), y1), fx, fy, rms, conf, dict(t.probs)


_SOLVED = ("rank", "fx", "fy", "rms_m", "conf", "scale", "minx", "miny", "maxx", "maxy")


def ordered_fold(rows: Iterator[tuple], s: Settings = DEFAULTS) -> Iterator[tuple]:
    """Fixes of rows (device, tick, floor_seq, *_SOLVED) that come sorted by device and tick."""
    device, tick, track, solved = None, None, Track(), {}
    for row in rows:
        if row[0] != device or row[1] != tick:
            if solved and (fix := step(track, tick, solved, s)):
                yield device, tick, *fix
            if row[0] != device:
                track = Track()
            device, tick, solved = row[0], row[1], {}
        solved[row[2]] = row[3:]
    if solved and (fix := step(track, tick, solved, s)):
        yield device, tick, *fix


def _fold(s: Settings, own: list[str]):
    names = [c.split()[0] for c in FIX.split(", floors")[0].split(", ")] + ["floors"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, n = [*own, "tick", "floor_seq", *_SOLVED], len(own)
        rows = ((r[:n], *r[n:]) for b in batches for r in b[columns].itertuples(index=False, name=None))
        block = []
        for (device, *_), *fix in ordered_fold(rows, s):
            block.append((device, *fix))
            if len(block) == 5000:
                yield pd.DataFrame(block, columns=names)
                block = []
        if block:
            yield pd.DataFrame(block, columns=names)

    return run


def hypotheses(rows: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Every solvable floor of every device and tick: its fix, score and solver bounds.

    One shuffle by device serves the jump gate, the grouping and the rank; the fit and its score come
    from the same row.
    """
    return solved_hypotheses(rd.with_jump_weights(rows, s), zones, s)


def solved_hypotheses(weighted: DataFrame, zones: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The same of readings that have their jump weights; a column ``piece`` is kept."""
    own = rd.history(weighted)
    grouped = weighted.groupBy(*own, "tick", "floor_seq", "scale").agg(
        F.min("slant").alias("nearest_m"), F.sort_array(F.collect_list(F.struct("rec_seq", "x", "y", "r", "w"))).alias("points"),
        F.min("x").alias("rx0"), F.min("y").alias("ry0"), F.max("x").alias("rx1"), F.max("y").alias("ry1"),
    ).filter(F.size("points") >= 3)
    prepared = zn.prepared_zones(zones, s)
    corners = (("min", "minx"), ("min", "miny"), ("max", "maxx"), ("max", "maxy"))
    box = prepared.select("floor_seq", *[F.expr(f"array_{m}(transform(zones, z -> z.box.{c}))").alias(f"z{c}") for m, c in corners])
    j = grouped.join(zn.small(box), "floor_seq", "left")
    x0, y0, x1, y1 = F.least("rx0", "zminx"), F.least("ry0", "zminy"), F.greatest("rx1", "zmaxx"), F.greatest("ry1", "zmaxy")
    m = s.bounds_margin * F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    # The rank needs only distances, so it is taken here, where rows still lie by device.
    rank = F.row_number().over(Window.partitionBy(*own, "tick").orderBy("nearest_m", "floor_seq"))
    bounds = [(x0 - m).alias("minx"), (y0 - m).alias("miny"), (x1 + m).alias("maxx"), (y1 + m).alias("maxy")]
    j = j.select(*own, "tick", "floor_seq", "scale", rank.alias("rank"), F.size("points").alias("n"), "points", *bounds)
    kept = [F.col(c).alias(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")]
    fixed = solve(j.select("*", *kept, f.min_weight_radius(F.col("scale"), s).alias("min_radius")))

    n = F.col("n")
    rms = F.sqrt(F.col("error_sum") / F.col("weight_sum")) * F.sqrt(n / F.greatest(n - 2.0, F.lit(1.0))) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    scored = fixed.withColumn("rms_m", rms)
    conf = 0.5 * F.least(F.lit(1.0), n / s.coverage_n) + 0.5 * f.fit_quality(F.col("rms_m"), s)
    scored = scored.join(zn.small(prepared), "floor_seq", "left")
    dead = F.coalesce(zn.in_no_go(F.col("fx"), F.col("fy"), F.col("zones")), F.lit(False))
    scored = scored.withColumn("conf", conf * F.when(dead, s.no_go_penalty).otherwise(1.0))
    return scored.select(*own, "tick", "floor_seq", "rank", "fx", "fy", "rms_m", "conf", "scale", *[F.col(f"b_{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def fold_fixes(solved: DataFrame, s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """Elected, smoothed and clipped fixes of solved hypotheses; pieces of a history, where there are any, each for itself."""
    own = rd.history(solved)
    ordered = solved.withColumn("device", F.col("device").cast("string")).repartition(*([tasks] if tasks else []), *own).sortWithinPartitions(*own, "tick", "floor_seq")
    return ordered.mapInPandas(_fold(s, own), FIX)


def track(states: DataFrame, receivers: DataFrame, zones: DataFrame, subzones: DataFrame | None = None, height: float | None = None, s: Settings = DEFAULTS, long_histories: bool = False, tasks: int | None = None) -> DataFrame:
    """Published fixes: position snapped into the zones, zone, nearest zone, sub-zone, parent zone.

    ``long_histories``: cut histories at their gaps, for one more pass over the readings, so that a few
    devices with most of the ticks do not keep a task each; the result is the same. ``tasks``: over how many tasks histories are dealt out, if
    not as many as a shuffle has.
    """
    rows = rd.readings(states, receivers, height, s)
    if long_histories:
        rows = rd.with_pieces(rows, s)
    if tasks:
        rows = rows.repartition(tasks, *rd.history(rows))
    return placed_in_zones(fold_fixes(hypotheses(rows, zones, s), s, tasks), zones, subzones, s)


def placed_in_zones(fixes: DataFrame, zones: DataFrame, subzones: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Fixes moved into the zones, with zone, nearest zone and, of sub-zones, sub-zone and parent zone."""
    snapped = snap_into_zones(fixes, zones, s)
    located = zn.locate(snapped, zones)
    if subzones is None:
        return located
    with_sub = zn.locate_subzone(located, subzones, zones)
    return with_sub.withColumn("parent_zone", F.coalesce("sub_parent", "zone")).drop("sub_parent")


def publish(fixes: DataFrame) -> DataFrame:
    """Rounded as published: raw positions to 2 places, error, confidence and floor probabilities to 3."""
    places = {"raw_x": 2, "raw_y": 2, "rms_m": 3, "conf": 3}
    rounded = {c: F.bround(c, n) for c, n in places.items() if c in fixes.columns}
    if "floors" in fixes.columns:
        rounded["floors"] = F.transform_values("floors", lambda _, p: F.bround(p, 3))
    return fixes.withColumns(rounded)
