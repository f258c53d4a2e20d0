import numpy as np
import pytest

from spatiotrack.operators.calibration import fit_biases
from spatiotrack.operators.solver import trilaterate


def one(points, bounds=(-np.inf, -np.inf, np.inf, np.inf), least=1e-3):
    p = np.array([(*q, 1.0)[:4] for q in points], float)
    b = np.array([bounds], float)
    return trilaterate(*[p[None, :, i] for i in range(4)], b[:, :2], b[:, 2:], np.array([least]))[0]


def test_exact_three_points():
    r = np.sqrt(50)
    assert one([(0, 0, r), (10, 0, r), (0, 10, r)]) == pytest.approx((5, 5), abs=0.05)


def test_spurious_short_reading_is_tamed_by_the_least_radius():
    truth = np.array([140.0, 140.0])
    far = [(x, y, float(np.hypot(x - 140, y - 140))) for x, y in ((0, 0), (300, 0), (0, 300))]
    points = [*far, (100, 100, 0.01), (140, 140, 20.0)]
    loose, tame = one(points), one(points, least=20.0)
    assert np.hypot(*(loose - truth)) - np.hypot(*(tame - truth)) > 15


def test_bounds_hold_and_beat_every_grid_point():
    points = [(0, 0, 30.0), (10, 0, 25.0), (0, 10, 25.0)]
    fix = one(points, (-2, -2, 12, 12))
    assert (fix >= -2).all() and (fix <= 12).all()
    p = np.array(points)

    def cost(q):
        return (((np.hypot(p[:, 0] - q[0], p[:, 1] - q[1]) - p[:, 2]) / p[:, 2]) ** 2).sum()

    grid = min(cost((x, y)) for x in np.linspace(-2, 12, 60) for y in np.linspace(-2, 12, 60))
    assert cost(fix) <= grid + 1e-9


def test_moves_with_the_plane():
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.uniform(0, 100, (5, 2)), rng.uniform(20, 80, 5)])
    a = one(p)
    turned = p.copy()
    turned[:, 0], turned[:, 1] = 7 - p[:, 1], 3 + p[:, 0]
    assert one(turned) == pytest.approx((7 - a[1], 3 + a[0]), abs=1e-4)


def test_planted_receiver_biases_are_found():
    rng = np.random.default_rng(2)
    n = 5
    rx_true, tx_true = rng.uniform(-0.1, 0.1, n), rng.uniform(-0.05, 0.05, n)
    tx_true -= tx_true.mean()
    tx, rx = (np.array(v) for v in zip(*[(i, j) for i in range(n) for j in range(n) if i != j], strict=True))
    receive, send = fit_biases(tx, rx, rx_true[rx] + tx_true[tx], np.ones(len(tx)), n)
    assert receive == pytest.approx(rx_true, abs=1e-4) and send == pytest.approx(tx_true, abs=1e-4)


def test_a_problem_goes_its_own_way_whichever_are_solved_beside_it():
    """Settled problems make room for others; each ends where it does alone, also with as many receivers as numpy adds up in turns."""
    rng = np.random.default_rng(5)
    for k in (3, 4, 9):
        n = 300
        x, y, r = rng.uniform(0, 900, (n, k)), rng.uniform(0, 900, (n, k)), rng.uniform(1, 700, (n, k))
        w = np.where(rng.random((n, k)) < 0.9, rng.random((n, k)), 0.0)
        lower, upper = np.full((n, 2), -50.0), np.full((n, 2), 950.0)
        args = (x, y, r, w, lower, upper, np.full(n, 20.0))
        whole = trilaterate(*args)
        assert np.array_equal(whole, trilaterate(*args, at_once=7))
        assert np.array_equal(whole, np.concatenate([trilaterate(*[a[i : i + 1] for a in args]) for i in range(n)]))
