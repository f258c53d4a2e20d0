"""The calibration fit against a fit with one matrix row a pair, and on a large floor."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from spatiotrack.constants import DEFAULTS, Settings
from spatiotrack.operators import calibration as cal


def dense_fit(tx: np.ndarray, rx: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, s: Settings = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Receive and send biases (log10) by projected damped Gauss-Newton within [-1, 1].

    Equations: each pair (long readings are cheap, short ones dear), differences of the two
    directions of a pair, and a gauge that keeps the mean send bias at zero.
    """
    m = len(y)
    pick = np.zeros((m, 2 * n))
    pick[np.arange(m), rx] = 1
    pick[np.arange(m), n + tx] = 1
    where = {(a, b): k for k, (a, b) in enumerate(zip(tx.tolist(), rx.tolist(), strict=True))}
    twice = [(k, where[b, a]) for (a, b), k in where.items() if a < b and (b, a) in where]
    ab, ba = (np.array(v, int) for v in zip(*twice, strict=True)) if twice else (np.zeros(0, int), np.zeros(0, int))
    differences, wanted = pick[ab] - pick[ba], y[ab] - y[ba]
    gauge = np.concatenate([np.zeros(n), np.full(n, s.gauge_weight / n)])

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = y - pick @ v
        up, down = np.maximum(e, 0), np.maximum(-e, 0)
        res = (s.positive_scale * np.log1p(up / s.positive_scale) - s.negative_slope * s.negative_scale * np.log1p(down / s.negative_scale)) * weight
        slope = np.where(e >= 0, 1 / (1 + up / s.positive_scale), s.negative_slope / (1 + down / s.negative_scale)) * weight
        rest = s.diff_weight * (differences @ v - wanted)
        res = np.concatenate([res, rest, [gauge @ v]])
        return res, np.vstack([-slope[:, None] * pick, s.diff_weight * differences, gauge])

    v, damping = np.zeros(2 * n), 1e-3
    res, jac = parts(v)
    now = res @ res
    for _ in range(400):
        grad = jac.T @ res
        free = ~(((v <= -1) & (grad > 0)) | ((v >= 1) & (grad < 0)))
        if np.abs(grad[free]).max(initial=0.0) < 1e-12:
            break
        h = jac[:, free].T @ jac[:, free]
        step = np.zeros(2 * n)
        step[free] = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-9), -grad[free])
        trial = np.clip(v + step, -1, 1)
        new, new_jac = parts(trial)
        then = new @ new
        if then < now:
            small_step = np.abs(trial - v).max() < 1e-13
            v, res, jac, now, damping = trial, new, new_jac, then, max(damping / 4, 1e-12)
            if small_step:
                break
        else:
            damping *= 5
            if damping > 1e10:
                break
    return v[:n], v[n:]


def floor(n, share, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    tx, rx = np.nonzero((rng.random((n, n)) < share) & ~np.eye(n, dtype=bool))
    place = rng.random((n, 2)) * 30
    true = np.hypot(*(place[tx] - place[rx]).T) + 0.3
    wall = np.where(rng.random(len(tx)) < 0.3, 0.2, 0.0)
    receive, send = rng.normal(0, spread, n), rng.normal(0, spread, n)
    return tx, rx, receive[rx] + send[tx] + wall + rng.normal(0, 0.01, len(tx)), 1 / (1 + true)


@pytest.mark.parametrize("n,share,spread", [(4, 1.0, 0.1), (9, 0.8, 0.3), (25, 0.3, 0.1), (6, 1.0, 2.0), (12, 0.15, 0.1)])
def test_equal_to_the_fit_with_a_row_for_each_pair(n, share, spread):
    for seed in range(4):
        tx, rx, y, w = floor(n, share, seed, spread)
        fit = cal.BiasFit(tx, rx, y, w, n)
        v, dense = fit.solve(), np.concatenate(dense_fit(tx, rx, y, w, n))
        # Biases of receivers without enough pairs are free along flat directions; costs and gradients are not.
        assert fit.cost(v) == pytest.approx(fit.cost(dense), abs=1e-9)
        if share >= 0.3:
            # As near as the rounding of the cost, by which both accept steps, lets them come.
            assert np.abs(v - dense).max() < 1e-7
        grad = fit.gradient(v)
        assert (np.abs(grad[np.abs(v) < 1]) < 1e-8).all()


def test_a_thousand_receivers_on_one_floor():
    tx, rx, y, w = floor(1000, 1.0, 1)
    assert len(y) > 990_000
    tracemalloc.start()
    fit = cal.BiasFit(tx, rx, y, w, 1000)
    v = fit.solve()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9 and np.abs(fit.gradient(v)[np.abs(v) < 1]).max() < 1e-6
