"""Weighted bounded trilateration of many fixes at once.

A batch of problems is padded to one array (problem, receiver) and solved by damped Gauss-Newton
steps with an analytic Jacobian, all problems in parallel. A coordinate that sits on its bound while
the gradient pushes outwards is held there (active set); the other goes on alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 300
#: Problems that are stepped at once: few enough for their arrays to stay in the cache.
AT_ONCE = 2048


def _total(a: np.ndarray) -> np.ndarray:
    """Sums over the receivers, added up in the order in which numpy adds up the row of a problem."""
    return a.sum(axis=0) if len(a) < 8 else np.ascontiguousarray(a.T).sum(axis=1)


def _distance(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The root written out, as in SQL: ``hypot`` takes seven times as long."""
    return np.sqrt(dx * dx + dy * dy)


def _cost(w: np.ndarray, e: np.ndarray) -> np.ndarray:
    return _total(w * e * e)


def trilaterate(x: np.ndarray, y: np.ndarray, r: np.ndarray, w: np.ndarray, lower: np.ndarray, upper: np.ndarray, min_radius: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """Positions (n, 2). Arrays are (n, k); a receiver that a problem lacks has weight 0. Start: the receivers' mean.

    Inside, arrays are (k, n). Problems that have settled make room for the next ones, so that a few
    slow ones do not keep many steps of few problems busy; each goes its own way, whichever go beside it.
    """
    there = w > 0
    weight = np.where(there, w / np.maximum(r, min_radius[:, None]) ** 2, 0.0)
    count = there.sum(axis=1)
    start = np.stack([np.where(there, x, 0).sum(axis=1), np.where(there, y, 0).sum(axis=1)], axis=1) / np.maximum(count, 1)[:, None]
    start = np.clip(start, lower, upper)
    out = start.copy()

    def entered(some: slice) -> list[np.ndarray]:
        """The state of problems before their first step: what a receiver has is (k, n), all else (n)."""
        xs, ys, rs, ws = (np.ascontiguousarray(a[some].T) for a in (x, y, r, weight))
        (px, py), (x0, y0), (x1, y1) = (np.ascontiguousarray(a[some].T) for a in (start, lower, upper))
        dx, dy = px - xs, py - ys
        d = _distance(dx, dy)
        n = np.arange(len(out))[some]
        return [n, np.zeros(len(n), int), np.zeros(len(n), bool), px, py, _cost(ws, d - rs), np.full(len(n), 1e-3), x0, y0, x1, y1, xs, ys, rs, ws, dx, dy, d]

    state, following = entered(slice(0, at_once)), at_once
    while len(state[0]):
        at, steps, done, px, py, now, damping, x0, y0, x1, y1, xs, ys, rs, ws, dx, dy, d = state
        far = np.maximum(d, 1e-12)
        ux, uy, e = dx / far, dy / far, far - rs
        wx, wy = ws * ux, ws * uy
        gx, gy = _total(wx * e), _total(wy * e)
        a, b, c = _total(wx * ux), _total(wx * uy), _total(wy * uy)
        held_x = ((px <= x0) & (gx > 0)) | ((px >= x1) & (gx < 0))
        held_y = ((py <= y0) & (gy > 0)) | ((py >= y1) & (gy < 0))
        lift = damping * (a + c) + 1e-300
        a2, c2 = a + lift, c + lift
        b2 = np.where(held_x | held_y, 0.0, b)
        det = np.maximum(a2 * c2 - b2 * b2, 1e-300)
        gx, gy = np.where(held_x, 0.0, gx), np.where(held_y, 0.0, gy)
        tx = np.minimum(np.maximum(px - (c2 * gx - b2 * gy) / det, x0), x1)
        ty = np.minimum(np.maximum(py - (a2 * gy - b2 * gx) / det, y0), y1)
        trial_dx, trial_dy = tx - xs, ty - ys
        trial_d = _distance(trial_dx, trial_dy)
        then = _cost(ws, trial_d - rs)
        better = then <= now
        moved = np.maximum(np.abs(tx - px), np.abs(ty - py))
        px, py, now = np.where(better, tx, px), np.where(better, ty, py), np.where(better, then, now)
        dx, dy, d = (trial_dx, trial_dy, trial_d) if better.all() else (np.where(better, trial_dx, dx), np.where(better, trial_dy, dy), np.where(better, trial_d, d))
        damping = np.where(better, np.maximum(damping / 5, 1e-12), np.minimum(damping * 6, 1e8))
        steps = steps + 1
        going = (moved > 1e-10) & ((damping < 1e8) | better) & (steps < STEPS)
        settled = ~(going | done)
        if settled.any():
            out[at[settled], 0], out[at[settled], 1] = px[settled], py[settled]
            done = done | settled
        state = [at, steps, done, px, py, now, damping, x0, y0, x1, y1, xs, ys, rs, ws, dx, dy, d]
        # Settled ones step on unheeded until there are enough of them to be worth a copy of the others.
        if 8 * np.count_nonzero(done) >= len(done):
            kept = np.flatnonzero(~done)
            state = [v[..., kept] for v in state]
            if following < len(out):
                added = entered(slice(following, following + at_once - len(kept)))
                following += at_once - len(kept)
                state = [np.concatenate(pair, axis=-1) for pair in zip(state, added)]
    return out


_ARRAYS = ("__x", "__y", "__r", "__w")
_LIMITS = ("minx", "miny", "maxx", "maxy", "min_radius")
_MADE = ("fx", "fy", "error_sum", "weight_sum")


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column side by side, and which places they fill."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    there = np.arange(width) < sizes[:, None]
    out = np.zeros(there.shape)
    out[there] = column.flatten().to_numpy(zero_copy_only=False)
    return out, there


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [n for n in b.schema.names if n not in (*_ARRAYS, *_LIMITS)]
        sizes = b.column("__x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        width = max(int(sizes.max(initial=0)), 1)
        (x, there), y, r, w = _padded(b.column("__x"), width), *[_padded(b.column(c), width)[0] for c in _ARRAYS[1:]]
        x0, y0, x1, y1, least = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _LIMITS)
        lower = np.nan_to_num(np.stack([x0, y0], axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        upper = np.nan_to_num(np.stack([x1, y1], axis=1), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        p = trilaterate(x, y, r, np.where(there, np.maximum(w, 1e-12), 0.0), lower, upper, least) if len(b) else np.zeros((0, 2))
        errors = np.where(there, w * (np.hypot(x - p[:, :1], y - p[:, 1:]) - r) ** 2, 0.0)
        few = sizes < 3
        made = [pa.array(c.astype(float), mask=few) for c in (p[:, 0], p[:, 1], errors.sum(axis=1), np.where(there, w, 0.0).sum(axis=1))]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keys], *made], [*keys, *_MADE])


def solve(problems: DataFrame) -> DataFrame:
    """Problems: any key columns, points (array of structs with x, y, r, w), minx, miny, maxx, maxy (null: unbounded), min_radius.

    Keys, fx, fy, and of the points at the fix the weighted sum of squared errors and the sum of
    weights; null with fewer than three points.
    """
    keys = [c for c in problems.columns if c not in ("points", *_LIMITS)]
    kinds = ", ".join(f"`{k}` {problems.schema[k].dataType.simpleString()}" for k in keys)
    arrays = [F.col(f"points.{c[2:]}").cast("array<double>").alias(c) for c in _ARRAYS]
    typed = problems.select(*keys, *arrays, *[F.col(c).cast("double").alias(c) for c in _LIMITS])
    return typed.mapInArrow(_solve, ", ".join([kinds, *[f"{c} double" for c in _MADE]]))
