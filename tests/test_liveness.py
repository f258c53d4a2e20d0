"""Liveness on a stream of dumps against the rule applied second by second, and timers of silent sources."""

import math
import random

from pyspark.sql import functions as F

from spatiotrack.sources import files
from spatiotrack.streaming.liveness import OUT, liveness_changes, liveness_stream
from spatiotrack.streaming.tracker import run_to_end

ROWS = "source string, at double, scanner string, last_seen double"


def dumps(seed, source, n=40):
    """Dumps every 15 seconds: fleets that stall, clocks that are reset, scanners that come and go."""
    rng, out, clock = random.Random(seed), [], 500.0
    for k in range(n):
        clock += 0 if k % 9 in (4, 5, 6) else 15
        if k % 17 == 16:
            clock = 40.0
        for i in range(5):
            if (k // 6 + i) % 5:
                out.append((source, 1000.0 + 15 * k, f"rx{i}", None if rng.random() < 0.05 else clock - rng.choice([0, 5, 12, 29, 30, 31, 80])))
        out.append((source, 1000.0 + 15 * k, None, clock - 1))
    return out


def by_seconds(rows, limit=30.0):
    """Status of each scanner at every second, by the rule as it stands; changes of it."""
    out, newest, anchor, ages, told = [], None, None, {}, {}
    by = {}
    for _, at, scanner, stamp in rows:
        by.setdefault(at, []).append((scanner, stamp))
    for now in range(int(min(by)), int(max(by)) + 1):
        if now in by:
            new = max([0.0, *[v for _, v in by[now] if v is not None]])
            if newest is None or not (newest - 60 < new <= newest):
                newest, anchor = new, now
                ages = {k: math.inf if v is None else new - v for k, v in by[now] if k is not None}
        for k in sorted({*told, *ages}):
            online = (ages[k] + now - anchor <= limit) if k in ages else None
            if k not in told or told[k] != online:
                # Ages are whole seconds here, so a second after the last good moment is when it shows.
                out.append((k, now if now in by and now == anchor else now - 1, online))
            told[k] = online
        told = {k: v for k, v in told.items() if v is not None}
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_changes_equal_the_rule_second_by_second(spark):
    rows = {s: dumps(seed, s) for seed, s in enumerate("abc")}
    df = frame(spark, [r for v in rows.values() for r in v]).repartition(5)
    got = liveness_changes(df).collect()
    for s, v in rows.items():
        assert sorted(((r.scanner, int(r.at), r.online) for r in got if r.source == s), key=str) == by_seconds(v), s


def test_the_stream_tells_the_same_in_any_batches(spark, tmp_path):
    rows = [r for seed, s in enumerate("ab") for r in dumps(seed, s)]
    want = sorted(map(str, map(tuple, liveness_changes(frame(spark, rows)).collect())))
    for parts in (1, 3):
        source, sink = files.work_folder(spark, "live-in"), files.work_folder(spark, "live-out")
        for k in range(parts):
            cut = [r for r in rows if int((r[1] - 1000) // 15) * parts // 40 == k]
            frame(spark, cut).write.mode("append").parquet(source)
            stream = spark.readStream.schema(frame(spark, []).schema).parquet(source)
            run_to_end(liveness_stream(stream, late="60 seconds"), sink, sink + "-state")
        got = spark.read.schema(OUT).parquet(sink)
        last = max(r[1] for r in rows)
        assert sorted(map(str, map(tuple, got.filter(F.col("at") <= last).collect()))) == want


def test_a_timer_tells_of_a_source_that_fell_silent(spark):
    source, sink = files.work_folder(spark, "live-in"), files.work_folder(spark, "live-out")
    parts = [[("a", 100.0, "rx1", 50.0), ("b", 100.0, "rx2", 70.0)], [("b", 300.0, "rx2", 270.0)], [("b", 301.0, "rx2", 271.0)], [("a", 90.0, "rx1", 60.0)]]
    for rows in parts:
        frame(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(source)
        run_to_end(liveness_stream(stream, late="10 seconds"), sink, sink + "-state")
    got = {(r.source, r.scanner, r.at, r.online) for r in spark.read.schema(OUT).parquet(sink).collect()}
    assert got == {("a", "rx1", 100.0, True), ("b", "rx2", 100.0, True), ("a", "rx1", 130.0, False), ("b", "rx2", 130.0, False), ("b", "rx2", 300.0, True)}
