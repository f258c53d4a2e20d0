"""Calibration from dumps, floors that leave the layout, and late ticks on the stream."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from spatiotrack.operators import calibration as cal
from spatiotrack.operators import diagnostics as dg
from spatiotrack.operators.folds import elect_floors
from spatiotrack.operators.tracking import Track, elect, publish, step
from spatiotrack.sources import files
from spatiotrack.streaming import calibration as sc
from spatiotrack.streaming import tracker

PLACES = {"a": (0.0, 0.0), "b": (400.0, 0.0), "c": (0.0, 300.0), "d": (400.0, 300.0)}
BIAS = {"a": 1.0, "b": 1.3, "c": 0.8, "d": 1.0}


def layout(names):
    receivers = [{"entity_id": n, "cords": {"x": PLACES[n][0], "y": PLACES[n][1]}} for n in names]
    return json.dumps({"floor": [{"name": "Ground", "scale": 40.0, "receivers": receivers}]})


def dump(at, names="abcd", stale=()):
    devices = {}
    for n in names:
        adverts = {}
        for o in names:
            if o != n:
                (x, y), (u, v) = PLACES[n], PLACES[o]
                true = ((x - u) ** 2 + (y - v) ** 2) ** 0.5 / 40
                adverts[o] = {"scanner_address": f"AA:{o}", "stamp": at - (100 if o in stale else 0), "rssi_distance_raw": true * BIAS[o]}
        devices[n] = {"_is_scanner": True, "address": f"AA:{n}", "name": n.upper(), "adverts": adverts}
    devices["phone"] = {"_is_scanner": False, "address": "ff", "adverts": {"x": {"scanner_address": "AA:a", "stamp": at + 1.0, "rssi_distance_raw": 2.0}}}
    devices["odd"] = {"address": None, "adverts": None}
    return json.dumps({"dump": at, "devices": devices})


def test_dumps_are_read_and_broken_ones_are_failed_calls(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join([dump(10.0), "{broken", dump(20.0, stale="d"), json.dumps({"dump": 30.0})]))
    dumps = sc.read_dumps(spark, str(tmp_path))
    assert dumps.filter("devices is null").count() == 2
    good = dumps.filter("devices is not null")
    assert sorted(r.name for r in sc.scanners(good).collect()) == ["A", "B", "C", "D"]
    receivers = spark.createDataFrame([(n, None) for n in "abcd"], "scanner string, uid string")
    got = sc.samples_of(good, receivers)
    per = {(r.dump, r.rx): r["count"] for r in got.groupBy("dump", "rx").count().collect()}
    assert per == {(10.0, n): 3 for n in "abcd"} | {(20.0, n): 3 for n in "abc"}


def test_manual_run_solves_or_ends_in_an_error(spark):
    receivers = spark.createDataFrame([(n, None, "Ground", 40.0, x, y, None, None) for n, (x, y) in PLACES.items()], "scanner string, uid string, floor string, scale double, x double, y double, height double, correction double")
    texts = lambda rows: sc.parse_dumps(spark.createDataFrame([(r,) for r in rows], "value string"))
    state, solved = sc.manual_calibration(texts([dump(float(t)) for t in range(0, 70, 10)]), receivers, " ground", 0.0, 60)
    c = {r.scanner: r.correction for r in solved.collect()}
    assert state == "done" and c["b"] < c["a"] < c["c"] and abs(c["a"] / c["b"] - 1.3) < 0.05
    failing = [dump(0.0), *[json.dumps({"dump": float(t)}) for t in range(10, 70, 10)]]
    assert sc.manual_calibration(texts(failing), receivers, "ground", 0.0, 60) == ("error", None)
    assert sc.manual_calibration(texts([dump(0.0, "ab")]), receivers, "ground", 0.0, 60) == ("error", None)
    assert sc.manual_calibration(texts([]), receivers, "ground", 0.0, 60) == ("error", None)


def test_continuous_job_solves_on_schedule_and_sees_new_receivers(spark, tmp_path):
    source, folder, at = tmp_path / "in", str(tmp_path / "out"), tmp_path / "layout.json"
    source.mkdir()
    at.write_text(layout("abc"))
    job = sc.ContinuousCalibration(spark, str(at), folder)

    def feed(k, times):
        (source / f"{k}.json").write_text("\n".join(dump(float(t)) for t in times))
        job.start(sc.stream_dumps(spark, str(source), 1), str(tmp_path / "state"), available_now=True).awaitTermination()

    feed(0, range(0, 180, 30))
    assert job.corrections() is None and job.table("selftest").count() == 3
    feed(1, range(180, 400, 30))
    first = {r.scanner: r.correction for r in job.corrections().collect()}
    assert set(first) == {"a", "b", "c"}
    at.write_text(layout("abcd"))
    feed(2, range(400, 600, 40))  # placed now, sampled, but no solve is due
    assert {r.scanner for r in job.corrections().collect()} == {"a", "b", "c"}
    assert job.table("samples").filter("rx = 'd'").count() > 0
    feed(3, range(1300, 1500, 40))
    assert {r.scanner for r in job.corrections().collect()} == {"a", "b", "c", "d"}
    at.write_text("{broken")
    feed(4, [3000])
    assert job.table("samples").agg(F.max("batch")).first()[0] == 3


def test_the_window_is_bounded_over_many_batches(spark, tmp_path):
    parts = files.Parts(spark, str(tmp_path / "w"))
    window, rng, rows = sc.RollingWindow(parts, keep=6, every=5), random.Random(1), []
    for k in range(60):
        new = [(float(k), rng.choice("ab"), rng.choice("cd"), float(i), rng.random()) for i in range(4)]
        rows += new
        window.add(spark.createDataFrame(new, window.SAMPLE).coalesce(1), k)
        if k % 17 == 9:  # a batch that is run again
            window.add(spark.createDataFrame(new, window.SAMPLE).coalesce(1), k)
        assert len(parts.batches("samples")) <= 2 * 5 and len(parts.batches("window")) <= 2
        if k % 7 == 3 or k == 59:
            want = set()
            for pair in {r[1:3] for r in rows}:
                want |= set(sorted(r for r in rows if r[1:3] == pair)[-6:])
            got = window.read(k)
            assert {tuple(r) for r in got.drop("seq").collect()} == want and got.count() == len(want)
    # At most a window and the parts since are read.
    assert len(got.inputFiles()) <= 5 + 4 * 4


def test_selftest_baseline_is_kept_and_compared(spark, tmp_path):
    rows = spark.createDataFrame([(0, "f", n, 3, 1.0, 2.0, e) for n, e in zip("abcd", (0.5, 1.0, 1.5, 2.0), strict=True)], "floor_seq int, floor string, scanner string, heard_by int, est_x double, est_y double, error_m double")
    sc.save_selftest(rows, str(tmp_path / "base"))
    back = sc.read_selftest(spark, str(tmp_path / "base"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    summary = lambda df: cal.selftest_summary(df.withColumn("place", F.lit(0)))
    change = {r.metric: (r.change_m, r.verdict) for r in sc.selftest_change(summary(rows.withColumn("error_m", F.col("error_m") / 2)), summary(back)).collect()}
    assert change["max_m"] == (-1.0, "improved") and all(v == "improved" for _, v in change.values())


def test_a_floor_that_leaves_the_layout_resets_the_election(spark):
    rows, want = [], []
    track = Track()
    for tick, (scores, valid) in enumerate([({0: 0.9, 1: 0.2}, [0, 1])] * 4 + [({0: 0.9, 1: 0.2}, [1])] * 2 + [({0: 0.9, 1: 0.2}, [0, 1])] * 2):
        rows += [("d", tick, k, c, valid) for k, c in scores.items()]
        want.append(elect(track, {k: c for k, c in scores.items() if k in valid}, set(valid)))
    got = elect_floors(spark.createDataFrame(rows, "device string, tick int, floor_seq int, conf double, valid array<int>")).orderBy("tick").collect()
    assert [r.floor_seq for r in got] == want == [0, 0, 0, 0, 1, 1, 1, 1]
    assert set(got[4].probs) == {1}
    moving = Track(incumbent=0, probs={0: 1.0}, kalman=[0, 1.0, 5.0, 0, 5.0, 0, 1, 0, 1], updated=1.0)
    fix = step(moving, 2, {1: (1, 7.0, 8.0, 0.1, 0.9, 1.0, 0, 0, 9, 9)}, valid={1})
    assert fix[:3] == (1, 7.0, 8.0)


def test_late_ticks_are_dropped_on_the_stream(spark, tmp_path):
    kind = "device string, tick int, ts timestamp, floor_seq int, rec_seq int, x double, y double, r double, slant double, scale double"
    corners = [(0.0, 0.0), (400.0, 0.0), (0.0, 400.0)]

    def rows(ticks):
        return spark.createDataFrame([("d", t, 0, k, x, y, 280.0, 7.0, 40.0) for t in ticks for k, (x, y) in enumerate(corners)], "device string, tick int, floor_seq int, rec_seq int, x double, y double, r double, slant double, scale double").withColumn("ts", F.timestamp_seconds("tick"))

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    zones = spark.createDataFrame([], "floor_seq int, zone_seq int, zone string, no_go boolean, poly boolean, ring array<struct<x:double,y:double>>")
    for ticks in ([5, 6, 8], [3, 7, 8, 9]):
        rows(ticks).select(*[c.split()[0] for c in kind.split(", ")]).coalesce(1).write.mode("append").parquet(source)
        tracker.run_to_end(tracker.track_stream(spark.readStream.schema(kind).parquet(source), zones), sink, sink + "-state")
    got = spark.read.schema(tracker.OUT).parquet(sink).filter("not pruned")
    assert sorted(r.tick for r in got.collect()) == [5, 6, 8, 9]


def test_sensors_appear_once_on_the_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(f"sensor.x_distance_to_{i}",) for i in ids] + [("sensor.other",)], "entity_id string").write.mode("append").parquet(source)
        tracker.run_to_end(tracker.first_seen(spark.readStream.schema("entity_id string").parquet(source)), sink, sink + "-state")
    assert sorted(r.entity_id[-1] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_recorder_drops_repeats_on_the_stream(spark, tmp_path):
    source, sink, kind = str(tmp_path / "in"), str(tmp_path / "out"), "ent string, updated double, ts timestamp"
    for rows in ([("a", 1.0), ("a", 1.0), ("b", 1.0)], [("a", 1.0), ("a", 2.0)]):
        spark.createDataFrame(rows, "ent string, updated double").withColumn("ts", F.timestamp_seconds("updated")).write.mode("append").parquet(source)
        tracker.run_to_end(tracker.recorder(spark.readStream.schema(kind).parquet(source)), sink, sink + "-state")
    assert sorted((r.ent, r.updated) for r in spark.read.parquet(sink).collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0)]


def test_ages_fold_by_source_as_one_list_would(spark):
    newest = [10.0, 5.0, 30.0, 29.0, 200.0, 150.0, 100.0, 201.0]
    before, want = None, []
    for v in newest:
        keep = not (before is not None and before - 60 < v <= before)
        before = v if keep else before
        want.append(keep)
    rows = [(s, k, v) for s in ("x", "y") for k, v in enumerate(newest)]
    got = dg.dump_ages(spark.createDataFrame(rows, "source string, dump long, last_seen double")).collect()
    for s in ("x", "y"):
        assert [r.anchored for r in sorted(got, key=lambda r: r.dump) if r.source == s] == want


def test_published_numbers_are_rounded(spark):
    fixes = spark.createDataFrame([("d", 1.23456, 0.98765, {0: 0.66666, 1: 0.33334})], "device string, raw_x double, conf double, floors map<int, double>")
    r = publish(fixes).first()
    assert (r.raw_x, r.conf, r.floors) == (1.23, 0.988, {0: 0.667, 1: 0.333})


def test_matching_goes_on_to_the_fixpoint_in_any_order(spark):
    """A chain in which each match makes the next one unique."""
    n = 40
    hexa = lambda k: f"{k * 2:06x}"
    placed = [(f"p{k}_{hexa(k)}", None) for k in range(n)]
    scanners = [(f"AA:BB:CC:{hexa(k)[:2]}:{hexa(k)[2:4]}:{hexa(k)[4:]}", f"gone {k}") for k in range(n)]
    for order in (1, -1):
        got = cal.match_scanners(spark.createDataFrame(placed[::order], "slug string, uid string"), spark.createDataFrame(scanners[::order], "address string, name string")).collect()
        assert len(got) == n and {r.slug.split("_")[0]: r.address for r in got} == {f"p{k}": a.lower() for k, (a, _) in enumerate(scanners)}


def test_permutations_of_typed_tokens(spark):
    from spatiotrack.functions import scalars as f

    rows = [(t, "AA:BB:CC:A1:B2:C3") for t in ("A1B2C3", "a1b2c0", "a1b2c4", "a1b2zz", "c3", None, "xA1B2C1")]
    got = [r[0] for r in spark.createDataFrame(rows, "token string, address string").select(f.token_matches(F.col("token"), F.col("address"))).collect()]
    assert got == [True, True, False, False, False, False, True]
    names = [("Büro Süd", "buro_sud"), ("Straße", "strasse"), ("Œuvre", "oeuvre"), ("Łódź", "lodz"), ("  --x--  ", "x"), ("日本", "")]
    assert [r[0] for r in spark.createDataFrame(names, "name string, slug string").select(f.slugify(F.col("name")) == F.col("slug")).collect()] == [True] * len(names)


def test_dump_ages_of_one_long_source_are_those_of_one_fold(spark):
    rng, rows, want = random.Random(5), [], {}
    for source in ("long", "stuck", "short"):
        before, now = None, 5000.0
        for dump in range({"long": 3000, "stuck": 400, "short": 3}[source]):
            now += rng.choice([-70, -61, -60, -59.5, -20, 0, 0, 0.25, 1, 15]) if source != "stuck" else 0 if dump != 200 else -30
            newest = None if source == "long" and dump % 701 == 5 else now + (rng.random() * 0 if source == "stuck" else rng.choice([0, 0, -3, 2]))
            rows.append((source, dump, newest))
            value = float("nan") if newest is None else newest
            keep = not (before is not None and before - 60 < value <= before)
            before = value if keep else before
            want[source, dump] = keep
    got = dg.dump_ages(spark.createDataFrame(rows, "source string, dump long, last_seen double"))
    assert {(r["source"], r["dump"]): r["anchored"] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would merge parts as small as these
    try:
        assert got.select("source", F.spark_partition_id().alias("p")).distinct().filter("source = 'long'").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
