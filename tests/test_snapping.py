"""Snapping by grids against the plain version, and its growth with the number of zones."""

import random
import time

import numpy as np
import plain_snapping as plain
import pytest
from pyspark.sql import functions as F

from spatiotrack.operators import snapping as sn
from spatiotrack.operators import zones as zn


def edges(ring):
    r = np.array(ring, float)
    return np.concatenate([r, np.roll(r, -1, axis=0)], axis=1)


def box(x, y, w, h):
    return edges([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])


def layout(rng, n):
    """Rooms with gaps and overlaps, and forbidden shapes inside, across and outside of them."""
    allowed = [box(rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(20, 300), rng.uniform(20, 300)) for _ in range(n)]
    forbidden = [edges([(x + rng.uniform(0, 80), y + rng.uniform(0, 80)) for _ in range(3)]) for x, y in [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(n // 2)]]
    return allowed, forbidden


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_all_walls(seed):
    rng = random.Random(seed)
    allowed, forbidden = layout(rng, 2 + 3 * seed)
    if seed == 1:
        allowed = []
    if seed == 2:
        forbidden = []
    p = np.array([(rng.uniform(-400, 1500), rng.uniform(-400, 1500)) for _ in range(150)] + [(1e6, -1e6)])
    new, old = sn.Region(allowed, forbidden, 3.0), plain.Region(allowed, forbidden, 3.0)
    got, want = new.snap(p), old.snap(p)
    far = lambda q: np.hypot(*(q - p).T)
    assert np.abs(far(got) - far(want)).max() < 1e-6
    assert (new.valid(p) == old.valid(p)).all()
    moved = far(got) > 0
    if allowed:
        assert new.valid(got[moved]).all() or not old.valid(want[moved]).all()


def test_odd_points_and_empty_regions():
    region = sn.Region([box(0, 0, 10, 10)], [box(4, 4, 2, 2)], 3.0)
    p = np.array([(np.nan, 1.0), (np.inf, 0.0), (1e6, 5.0), (5.0, 5.0)])
    out = region.snap(p)
    assert np.isnan(out[0, 0]) and np.isinf(out[1, 0]) and out[2] == pytest.approx((10.0, 5.0)) and region.valid(out[3:]).all()
    assert (sn.Region([], [], 3.0).snap(p[2:]) == p[2:]).all()
    # Nothing is left of the only room: points stay.
    assert (sn.Region([box(0, 0, 4, 4)], [box(-9, -9, 30, 30)], 3.0).snap(p[3:]) == p[3:]).all()


def test_no_valid_point_of_a_lattice_is_nearer():
    rng = random.Random(11)
    allowed, forbidden = layout(rng, 9)
    region = sn.Region(allowed, forbidden, 3.0)
    p = np.array([(rng.uniform(-100, 1300), rng.uniform(-100, 1300)) for _ in range(60)])
    x, y = np.meshgrid(np.arange(-50, 1300, 4.0), np.arange(-50, 1300, 4.0))
    lattice = np.stack([x.ravel(), y.ravel()], axis=1)
    lattice = lattice[plain.Region(allowed, forbidden, 3.0).valid(lattice)]
    got = region.snap(p)
    nearest = np.array([np.hypot(*(lattice - q).T).min() for q in p])
    assert (np.hypot(*(got - p).T) <= nearest + 1e-6).all()


def test_work_grows_with_the_zones_near_by():
    rng = random.Random(3)
    took = {}
    for n in (10, 40):
        allowed = [box(i * 60, j * 60, 50, 50) for i in range(n) for j in range(n)]
        forbidden = [box(i * 60 + 20, j * 60 + 20, 10, 10) for i in range(n) for j in range(n)]
        p = np.array([(rng.uniform(0, 60 * n), rng.uniform(0, 60 * n)) for _ in range(2000)])
        start = time.process_time()
        region = sn.Region(allowed, forbidden, 3.0)
        out = region.snap(p)
        took[n] = time.process_time() - start
        assert region.valid(out).all()
    # Sixteen times as many zones; every point against every wall would take sixteen times as long, every wall against every wall 256 times.
    assert took[40] < 40 * took[10] + 1


def test_shipped_and_joined_floors_agree(spark, monkeypatch):
    from spatiotrack.sources import fixtures as fx

    rng = random.Random(5)
    points = spark.createDataFrame([(rng.randint(0, 2), i, rng.uniform(0, 2000), rng.uniform(0, 1400)) for i in range(300)] + [(None, -1, 5.0, 5.0), (9, -2, 5.0, 6.0)], "floor_seq int, id int, x double, y double")
    a = sn.snap_into_zones(points, fx.zones(spark))
    monkeypatch.setattr(zn, "is_small", lambda df, limit=0: False)
    b = sn.snap_into_zones(points, fx.zones(spark))
    read = lambda df: {r.id: (r.floor_seq, round(r.x, 6), round(r.y, 6)) for r in df.collect()}
    assert read(a) == read(b) and len(read(a)) == 302
    assert a.filter(F.col("id") == -2).first().y == 6.0
