"""The live chain under a layout that changes, late ticks, pruning, and batches that are run again."""

import json

import pytest
from pyspark.sql import functions as F

from spatiotrack.api import Layout
from spatiotrack.operators import readings as rd
from spatiotrack.operators import tracking as tk
from spatiotrack.sources import files
from spatiotrack.streaming.live import LiveTracker

CORNERS = [(0.0, 0.0), (800.0, 0.0), (0.0, 800.0), (800.0, 800.0)]


def document(floors, shift=0.0, zone="hall"):
    """A layout of floors (name, scanner prefix), each with four receivers and two zones."""
    return {"floor": [{"name": name, "scale": 40.0, "receivers": [{"entity_id": f"{p}{i}", "cords": {"x": x + shift, "y": y}} for i, (x, y) in enumerate(CORNERS)],
        "zones": [{"zone_id": "a", "entity_id": zone, "poly": True, "cords": [{"x": x, "y": y} for x, y in ((0, 0), (400, 0), (400, 800), (0, 800))]}, {"zone_id": "b", "entity_id": "rest", "poly": True, "cords": [{"x": x, "y": y} for x, y in ((400, 0), (800, 0), (800, 800), (400, 800))]}],
        "subzones": [{"sub_zone_id": "s", "entity_id": "desk", "parent": "a", "poly": True, "cords": [{"x": x, "y": y} for x, y in ((0, 0), (300, 0), (300, 300), (0, 300))]}]} for name, p in floors]}


def store(spark, path, doc):
    files.save_layout(files.parse_layout(spark.createDataFrame([(json.dumps(doc),)], "value string")), path)


def states(spark, ticks, devices=("anna", "ben")):
    rows = []
    for d, device in enumerate(devices):
        for t in ticks:
            x, y = 100 + 30 * t + 200 * d, 700 - 25 * t
            for p, far in (("g", 0.5), ("u", 3.0 - 0.3 * t)):
                for i, (cx, cy) in enumerate(CORNERS):
                    m = (((x - cx) ** 2 + (y - cy) ** 2) ** 0.5) / 40 + abs(far) + 0.1 * ((t * 7 + i * 3 + d) % 5)
                    rows.append((t, f"sensor.{device}_distance_to_{p}{i}", "unknown" if (t + i) % 11 == 0 else f"{m:.3f}", "m"))
    return spark.createDataFrame(rows, "tick int, entity_id string, state string, unit string")


def rows_of(df):
    return {(r.device, r.tick): r for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        for c in ("x", "y", "raw_x", "raw_y", "rms_m", "conf"):
            assert a[k][c] == pytest.approx(b[k][c], abs=1e-6), (k, c)
        assert [a[k][c] for c in ("zone", "nearest_zone", "sub_zone", "parent_zone", "no_go")] == [b[k][c] for c in ("zone", "nearest_zone", "sub_zone", "parent_zone", "no_go")], k


def test_the_layout_may_change_between_batches(spark, tmp_path):
    path, before = str(tmp_path / "layout"), document([("ground", "g"), ("up", "u")])
    # Receivers move, a zone gets another name.
    after = document([("ground", "g"), ("up", "u")], shift=15.0, zone="lobby")
    live = LiveTracker(spark, lambda: Layout.read(spark, path), str(tmp_path / "out"))
    store(spark, path, before)
    live(states(spark, range(1, 6)), 0)
    store(spark, path, after)
    live(states(spark, range(6, 9)), 1)
    live(states(spark, range(9, 13)), 2)

    store(spark, path + "-before", before)
    plans = [(Layout.read(spark, path + "-before"), range(1, 6)), (Layout.read(spark, path), range(6, 13))]
    readings = [rd.readings(states(spark, t), p.receivers) for p, t in plans]
    weighted = rd.with_jump_weights(readings[0].unionByName(readings[1]))
    solved = [tk.solved_hypotheses(weighted.filter(F.col("tick").between(t[0], t[-1])), p.zones) for p, t in plans]
    fixes = tk.fold_fixes(solved[0].unionByName(solved[1]))
    want = [tk.placed_in_zones(fixes.filter(F.col("tick").between(t[0], t[-1])), p.zones, p.subzones) for p, t in plans]
    same(rows_of(want[0].unionByName(want[1])), rows_of(live.fixes()))
    zones = {r.zone for k, r in rows_of(live.fixes()).items() if k[1] > 5}
    assert "hall" not in zones


def test_floors_are_known_by_name(spark, tmp_path):
    path = str(tmp_path / "layout")
    live = LiveTracker(spark, lambda: Layout.read(spark, path), str(tmp_path / "out"))
    store(spark, path, document([("up", "u"), ("ground", "g")]))
    live(states(spark, range(1, 6)), 0)
    # The floors change places: whoever was on a floor still is.
    store(spark, path, document([("ground", "g"), ("up", "u")]))
    live(states(spark, range(6, 8)), 1)
    once = LiveTracker(spark, lambda: Layout.read(spark, path), str(tmp_path / "once"))
    once(states(spark, range(1, 8)), 0)
    got, want = rows_of(live.fixes()), rows_of(once.fixes())
    assert got.keys() == want.keys()
    for k in got:
        assert got[k].x == pytest.approx(want[k].x) and got[k].floor_seq == (want[k].floor_seq if k[1] > 5 else 1 - want[k].floor_seq), k
    # A floor that is gone takes election and filter of its devices with it.
    store(spark, path, document([("up", "u")]))
    live(states(spark, range(8, 10)), 2)
    last = {k: r for k, r in rows_of(live.fixes()).items() if k[1] > 7}
    assert {r.floor_seq for r in last.values()} == {0} and all(last[d, 8].x == pytest.approx(min(max(last[d, 8].raw_x, 0), 800)) for d in ("anna", "ben"))


def test_late_ticks_pruning_and_batches_run_again(spark, tmp_path):
    path = str(tmp_path / "layout")
    store(spark, path, document([("ground", "g"), ("up", "u")]))
    live = LiveTracker(spark, lambda: Layout.read(spark, path), str(tmp_path / "out"))
    live(states(spark, [1, 2, 4]), 0)
    live(states(spark, [3, 4, 5]), 1)
    first = rows_of(live.fixes())
    assert {k[1] for k in first} == {1, 2, 4, 5}
    live(states(spark, [3, 4, 5]), 1)
    same(first, rows_of(live.fixes()))
    live(states(spark, [400], ["ben"]), 2)
    assert [r.device for r in spark.read.parquet(str(tmp_path / "out" / "pruned")).collect()] == ["anna"]
    assert [r.device for r in spark.read.parquet(str(tmp_path / "out" / "state" / "batch=2")).collect()] == ["ben"]
    live(states(spark, [401]).filter("false"), 3)
    assert not (tmp_path / "out" / "state" / "batch=0").exists() and (tmp_path / "out" / "state" / "batch=2").exists()
    # Without a usable layout nothing is located, and nothing is lost.
    (tmp_path / "gone").mkdir()
    live.layout = lambda: Layout.read(spark, str(tmp_path / "nowhere"))
    live(states(spark, [402], ["ben"]), 4)
    live.layout = lambda: Layout.read(spark, path)
    live(states(spark, [403], ["ben"]), 5)
    assert ("ben", 403) in rows_of(live.fixes()) and ("ben", 402) not in rows_of(live.fixes())


def test_a_larger_batch_makes_more_tasks_and_not_larger_ones(spark, tmp_path, monkeypatch):
    from spatiotrack.streaming import live as lv

    path, seen, solved = str(tmp_path / "layout"), [], tk.solved_hypotheses
    monkeypatch.setattr(lv, "ROWS_A_TASK", 4)
    monkeypatch.setattr(tk, "solved_hypotheses", lambda weighted, *rest: (seen.append(weighted.rdd.getNumPartitions()), solved(weighted, *rest))[1])
    store(spark, path, document([("ground", "g"), ("up", "u")]))
    live = LiveTracker(spark, lambda: Layout.read(spark, path), str(tmp_path / "out"))
    live(states(spark, range(1, 9)), 0)
    assert seen == [32] and live.fixes().count()
