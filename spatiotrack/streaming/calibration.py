"""Calibration from scanner dumps: sources, the bounded manual run, and the continuous job.

A dump is one JSON document a line, ``{"dump": seconds, "devices": {...}}``; a line that is no such
document is a failed call, with ``devices`` null. Schedules run on the dumps' own clock, so a replayed
batch decides the same again, and everything a batch writes goes to a folder of its own number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..functions import scalars as f
from ..operators import calibration as cal
from ..sources import files

ADVERT = "struct<scanner_address:string,stamp:double,rssi_distance_raw:double>"
DEVICE = f"struct<_is_scanner:boolean,address:string,name:string,last_seen:double,adverts:map<string,{ADVERT}>>"
DUMP = f"dump double, devices map<string,{DEVICE}>"


def parse_dumps(texts: DataFrame, column: str = "value") -> DataFrame:
    """dump, devices of JSON texts; devices is null for a failed call."""
    return texts.select(F.from_json(column, DUMP).alias("d")).select("d.*")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    return parse_dumps(spark.read.text(path))


def stream_dumps(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The same from files as they arrive in a folder."""
    reader = spark.readStream.format("text")
    return parse_dumps((reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path))


def _devices(dumps: DataFrame) -> DataFrame:
    return dumps.select("dump", F.explode(F.map_values("devices")).alias("d"))


def scanners(dumps: DataFrame) -> DataFrame:
    """address, name: each scanner under its newest name."""
    s = _devices(dumps).filter("d._is_scanner").select("dump", F.lower("d.address").alias("address"), F.coalesce("d.name", F.lit("")).alias("name"))
    return s.groupBy("address").agg(F.max_by("name", F.struct("dump", "name")).alias("name"))


def adverts(dumps: DataFrame) -> DataFrame:
    """dump, address, scanner_address, stamp, distance: one row for each advert of each device."""
    a = _devices(dumps).select("dump", F.col("d.address").alias("address"), F.explode(F.map_values("d.adverts")).alias("a"))
    return a.select("dump", "address", "a.scanner_address", "a.stamp", F.col("a.rssi_distance_raw").alias("distance"))


def samples_of(dumps: DataFrame, receivers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """dump, tx, rx, stamp, distance_m: what the dumps say of placed receivers (scanner, uid)."""
    matches = cal.match_scanners(receivers.select(F.col("scanner").alias("slug"), "uid"), scanners(dumps))
    return cal.ingest_dump(adverts(dumps), matches.select("address", "slug"), s)


# Schedules.
def manual_runs(calls: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """How each manual run went: run, state ('error' or 'done'), ended_at, dumps.

    calls (run, at, ok), one row a call. A run ends in an error at its sixth failed call in a row;
    dumps are the good calls until then. A run has a bounded number of calls.
    """
    so_far = Window.partitionBy("run").orderBy("at")
    streak = F.sum(F.col("ok").cast("int")).over(so_far)
    c = calls.withColumn("__good", streak)
    c = c.withColumn("__failed", F.count_if(~F.col("ok")).over(Window.partitionBy("run", "__good").orderBy("at")))
    broken = F.min(F.when(F.col("__failed") >= s.manual_failures, F.col("at"))).over(Window.partitionBy("run"))
    c = c.withColumn("__broken", broken).filter(F.col("__broken").isNull() | (F.col("at") <= F.col("__broken")))
    return c.groupBy("run").agg(F.when(F.max("__broken").isNotNull(), "error").otherwise("done").alias("state"), F.max("at").alias("ended_at"), F.count_if("ok").alias("dumps"))


def due_times(calls: DataFrame, every: float, after: float = 0.0) -> DataFrame:
    """run, at: the calls that a periodic job answers: ``after`` seconds or more from the run's first call and ``every`` or more from the last answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, last = None, 0.0, None
        for b in batches:
            keep = []
            for key, at in b[["run", "at"]].itertuples(index=False, name=None):
                if key != now:
                    now, started, last = key, at, None
                due = at - started >= after and (last is None or at - last >= every)
                last = at if due else last
                keep.append(due)
            yield b[keep]

    ordered = calls.select(F.col("run").cast("string"), F.col("at").cast("double")).repartition("run").sortWithinPartitions("run", "at")
    return ordered.mapInPandas(run, "run string, at double")


def solve_times(calls: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """When the continuous calibration solves."""
    return due_times(calls, s.solve_every_s, s.solve_after_s)


# Solving.
def solve_floors(samples: DataFrame, receivers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Corrections (floor, scanner, correction, db, pairs, low_confidence) of all floors with three receivers or more."""
    per = receivers.groupBy(f.normalized(F.col("floor")).alias("__f")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    on = receivers.join(per, f.normalized(F.col("floor")) == F.col("__f"), "left_semi")
    pairs = cal.usable_pairs(samples, on, s)
    return cal.corrections(cal.calibrate(pairs, s), pairs, s)


def manual_calibration(dumps: DataFrame, receivers: DataFrame, floor: str, started: float, duration: float | None = None, s: Settings = DEFAULTS) -> tuple[str, DataFrame | None]:
    """One manual run over a table of dumps: its state ('done' or 'error') and the floor's corrections.

    The window takes ``duration`` seconds (one minute to one hour); the first dump after it counts
    too. Too many failures in a row, or too few pairs, end it in an error.
    """
    length = min(3600.0, max(60.0, 600.0 if duration is None else float(duration)))
    there = receivers.filter(f.normalized(F.col("floor")) == f.normalized(F.lit(floor)))
    inside = dumps.filter(F.col("dump").between(started, started + length))
    went = manual_runs(inside.select(F.lit(0).alias("run"), F.col("dump").alias("at"), F.col("devices").isNotNull().alias("ok")), s).first()
    if went is None or went["state"] == "error":
        return "error", None
    after = dumps.filter((F.col("dump") > started + length) & F.col("devices").isNotNull()).agg(F.min("dump")).first()[0]
    good = inside if after is None else inside.unionByName(dumps.filter(F.col("dump") == after))
    taken = samples_of(good.filter("devices is not null"), there, s).withColumn("seq", F.col("stamp"))
    solved = solve_floors(cal.rolling_window(taken, s.window), there, s)
    return ("done", solved) if solved.limit(1).count() else ("error", None)


class RollingWindow:
    """The newest ``keep`` samples of each directed pair, over batches without end.

    A batch writes its own samples as a part. Every ``every`` batches the window so far and the parts
    since are compacted into a new window, and what both replace is deleted. A read takes one window, at
    most ``keep`` rows a pair, and the parts of fewer than ``every`` batches, however long the job has run.
    """

    SAMPLE = "dump double, tx string, rx string, stamp double, distance_m double"

    def __init__(self, parts: files.Parts, keep: int, every: int = 20):
        self.parts, self.keep, self.every = parts, keep, every

    def _newest(self, rows: DataFrame) -> DataFrame:
        return cal.rolling_window(rows.withColumn("seq", F.struct("dump", "stamp")), self.keep)

    def _since(self, batch: int) -> tuple[int, list[int]]:
        """The window before ``batch`` (-1: none) and the batches with parts from there on, itself included."""
        window = max((b for b in self.parts.batches("window") if b < batch), default=-1)
        return window, [b for b in self.parts.batches("samples") if window < b <= batch]

    def read(self, batch: int) -> DataFrame:
        """The window after ``batch``, with ``seq``."""
        _, since = self._since(batch)
        return self._newest(self.parts.newest("window", batch, self.SAMPLE).unionByName(self.parts.some("samples", since, self.SAMPLE)))

    def add(self, samples: DataFrame, batch: int) -> None:
        self.parts.write(samples.select("dump", "tx", "rx", "stamp", "distance_m"), "samples", batch)
        window, since = self._since(batch)
        if len(since) >= self.every:
            self.parts.write(self.read(batch).drop("seq"), "window", batch)
            # The window before and its parts stay once more, as this batch may be run again.
            self.parts.forget("window", window)
            self.parts.forget("samples", window + 1)


CORRECTION = "floor string, scanner string, correction double"


class ContinuousCalibration:
    """A ``foreachBatch`` handler: samples every dump, and on the dumps' clock solves, tests and writes.

    Each batch reads the layout anew, so receivers placed, moved or linked since are known at once;
    if the layout cannot be read, or has no receivers, the batch keeps its samples out and waits.
    Corrections of a floor change only if it has none or one changed by ``write_epsilon``. Under
    ``folder``: samples and window, corrections (each part holds all in force), selftest and state.
    Nothing that a batch reads grows with time.
    """

    def __init__(self, spark: SparkSession, layout: str, folder: str, s: Settings = DEFAULTS, compact_every: int = 20):
        self.spark, self.layout, self.s = spark, layout, s
        self.parts = files.Parts(spark, folder)
        self.window = RollingWindow(self.parts, s.window, compact_every)

    def table(self, name: str) -> DataFrame | None:
        """All parts of a table that are still there; None if there is none."""
        there = self.parts.batches(name)
        return self.spark.read.option("basePath", f"{self.parts.folder}/{name}").parquet(*[self.parts.path(name, b) for b in there]) if there else None

    def corrections(self) -> DataFrame | None:
        """Those in force."""
        there = self.parts.batches("corrections")
        return self.parts.some("corrections", there[-1:], CORRECTION) if there else None

    def _state(self, batch: int) -> dict:
        last = self.parts.newest("state", batch, "text string").first()
        return json.loads(last[0]) if last else {}

    def __call__(self, dumps: DataFrame, batch: int) -> None:
        s, spark = self.s, self.spark
        now = dumps.agg(F.max("dump")).first()[0]
        receivers = files.calibration_receivers(files.read_layout(spark, self.layout))
        if now is None or not receivers.limit(1).count():
            return
        state = self._state(batch)
        state.setdefault("started", dumps.agg(F.min("dump")).first()[0])
        self.window.add(samples_of(dumps.filter("devices is not null"), receivers, s), batch)
        if now - state["started"] >= s.solve_after_s and now - state.get("solved", float("-inf")) >= s.solve_every_s:
            state["solved"] = now
            found = solve_floors(self.window.read(batch), receivers, s).select("floor", "scanner", "correction")
            before = self.parts.newest("corrections", batch, CORRECTION)
            changed = found.join(cal.worth_writing(found, before, s).select("floor"), "floor", "left_semi")
            self.parts.write(changed.unionByName(before.join(changed.select("floor").distinct(), "floor", "left_anti")), "corrections", batch)
            self.parts.forget_replaced("corrections", batch)
        if now - state.get("tested", float("-inf")) >= s.selftest_every_s:
            state["tested"] = now
            layout = files.read_layout(spark, self.layout)
            errors = cal.selftest(self.window.read(batch), files.selftest_receivers(layout), files.zones(layout), s)
            self.parts.write(errors.withColumn("at", F.lit(float(now))), "selftest", batch)
        self.parts.write(spark.createDataFrame([(json.dumps(state),)], "text string").coalesce(1), "state", batch)
        self.parts.forget_replaced("state", batch)

    def start(self, dumps: DataFrame, checkpoint: str, available_now: bool = False):
        writer = dumps.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{int(self.s.dump_every_s)} seconds")).start()


# Baselines of the self-test.
def save_selftest(errors: DataFrame, path: str) -> None:
    """The self-test's rows as JSON, to compare later ones with."""
    errors.write.mode("overwrite").json(path)


def read_selftest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("floor_seq int, floor string, scanner string, heard_by int, est_x double, est_y double, error_m double").json(path)


def selftest_change(summary: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, now_m, baseline_m, change_m, verdict ('improved', 'worse', 'same') of two totals of ``selftest_summary``."""
    metrics = ("cep50_m", "cep95_m", "mean_m", "max_m")
    long = lambda df, name: df.filter("floor is null").select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))
    j = long(summary, "now_m").join(long(baseline, "baseline_m"), "metric").withColumn("change_m", F.round(F.col("now_m") - F.col("baseline_m"), 3))
    return j.withColumn("verdict", F.when(F.col("change_m") < 0, "improved").when(F.col("change_m") > 0, "worse").when(F.col("change_m") == 0, "same"))
