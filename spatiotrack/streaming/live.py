"""The whole chain on a stream: raw states in, published fixes with zones out, under a layout that may change.

A ``foreachBatch`` handler. Every micro-batch reads the layout anew, so receivers, floors and zones
that were placed, moved or removed since count at once, as in the batch chain, whose functions do
all the work here. What a device carries from batch to batch is kept in two tables in the folder,
one part a batch: ``gate`` (the readings of its last cycle, for the jump gate) and ``state`` (election
and filter, a row a device). Floors are kept by name, as their numbers change with the layout. A part
is written from the newest one before it, so a batch that is run again after a failure gives the same,
and older parts are deleted. A device that published nothing for ``stale_s`` is pruned.

Edge cases: a tick at or behind the last one of its device is dropped, as the newer fix is out; a
batch without readings prunes; a layout that cannot be read has no receivers, so nothing is located
and devices keep their state until they are pruned.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULTS, Settings
from ..operators import readings as rd
from ..operators import tracking as tk
from ..operators.zones import small
from ..sources.files import Parts, WorkTables

GATE = "device string, tick int, floor string, rec_seq int, x double, y double, r double, slant double, scale double"
STATE = "device string, updated double, track string"
STEP = "kind int, device string, tick int, floor_seq int, x double, y double, raw_x double, raw_y double, rms_m double, conf double, floors map<int,double>, updated double, track string"
NAMES = [c.split()[0] for c in STEP.split(", ")]

#: Readings of one task: a larger batch makes more tasks, not larger ones, whatever number of partitions the session has.
ROWS_A_TASK = 250_000

#: A floor that the layout no longer has: none of the valid ones.
GONE = -1

_CARRIED, _FIX, _PRUNED = 0, 1, 2


def dump(t: tk.Track, names: dict[int, str]) -> str:
    floor = lambda k: names.get(k)
    kalman = None if t.kalman is None else [floor(t.kalman[0]), *t.kalman[1:]]
    return json.dumps([{floor(k): p for k, p in t.probs.items()}, floor(t.incumbent), floor(t.rival), t.rival_count, t.dark, kalman, t.updated, t.tick])


def load(text: str, floors: dict[str, int]) -> tk.Track:
    """A device's state under the floors of today's layout."""
    probs, incumbent, rival, count, dark, kalman, updated, tick = json.loads(text)
    t = tk.Track({floors[k]: p for k, p in probs.items() if k in floors}, None if incumbent is None else floors.get(incumbent, GONE), floors.get(rival), count, dark, None, updated, tick)
    if kalman is not None and kalman[0] in floors:
        t.kalman = [floors[kalman[0]], *kalman[1:]]
    return t


def _fold(floors: dict[str, int], now: float, s: Settings):
    """Steps of rows sorted by device, kind, tick and floor: carried state first, then solved floors; the state that results comes last."""
    valid, names = set(floors.values()), {k: name for name, k in floors.items()}

    def steps(rows: Iterator[tuple]) -> Iterator[tuple]:
        device, track, tick, solved = None, tk.Track(), None, {}

        def close() -> Iterator[tuple]:
            nonlocal solved
            if solved and (fix := tk.step(track, tick, solved, s, valid)):
                yield (_FIX, device, tick, *fix, None, None)
            if solved:
                track.tick = tick
            solved = {}

        def end() -> Iterator[tuple]:
            yield from close()
            seen = track.updated if track.updated is not None else track.tick * s.tick_s
            if now - seen > s.stale_s:
                yield (_PRUNED, device, *[None] * (len(NAMES) - 2))
            else:
                yield (_CARRIED, device, *[None] * (len(NAMES) - 4), track.updated, dump(track, names))

        for kind, d, t, floor, carried, *rest in rows:
            if d != device:
                if device is not None:
                    yield from end()
                device, track, tick = d, tk.Track(), None
            if kind == _CARRIED:
                track = load(carried, floors)
                continue
            if t != tick:
                yield from close()
                tick = t
            solved[floor] = tuple(rest)
        if device is not None:
            yield from end()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "device", "tick", "floor_seq", "track", *tk._SOLVED]
        block = []
        for row in steps(r for b in batches for r in b[columns].itertuples(index=False, name=None)):
            block.append(row)
            if len(block) == 5000:
                yield pd.DataFrame(block, columns=NAMES)
                block = []
        if block:
            yield pd.DataFrame(block, columns=NAMES)

    return run


class LiveTracker:
    """Handler of micro-batches of states (tick, entity_id, state, unit); results under ``folder``: fixes and pruned, one part a batch.

    ``layout`` is called for each batch and gives floors, receivers, zones, subzones and tracker_height(), as ``api.Layout`` does.
    """

    def __init__(self, spark: SparkSession, layout: Callable, folder: str, s: Settings = DEFAULTS):
        self.spark, self.layout, self.parts, self.s = spark, layout, Parts(spark, folder), s

    def fixes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.parts.folder}/fixes").drop("batch")

    def __call__(self, states: DataFrame, batch: int) -> None:
        s, work, parts, plan = self.s, WorkTables(), self.parts, self.layout()
        gate, carried = parts.newest("gate", batch, GATE), parts.newest("state", batch, STATE)
        # The floors of one layout document: a name and a number each.
        floors = {r["floor"]: r["floor_seq"] for r in plan.floors.select("floor", "floor_seq").collect()}

        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-states.count() // ROWS_A_TASK))
        dealt = lambda df: df.repartition(n, "device")

        last = gate.groupBy("device").agg(F.max("tick").alias("__last"))
        rows = dealt(rd.readings(states, plan.receivers, plan.tracker_height(), s)).join(dealt(last), "device", "left").filter("__last is null or tick > __last")
        new = work.keep(rows.select("device", F.col("tick").cast("int").alias("tick"), "floor_seq", "floor", F.col("rec_seq").cast("int").alias("rec_seq"), "x", "y", "r", "slant", "scale"), "live-readings")

        numbers = small(plan.floors.select("floor", "floor_seq"))
        both = gate.join(numbers, "floor").withColumn("__old", F.lit(True)).unionByName(new.withColumn("__old", F.lit(False)))
        weighted = rd.with_jump_weights(dealt(both), s).filter(~F.col("__old"))
        solved = tk.solved_hypotheses(weighted, plan.zones, s)

        newest = dealt(gate.select("device", "tick").unionByName(new.select("device", "tick"))).groupBy("device").agg(F.max("tick").alias("tick"))
        now = float(newest.agg(F.max("tick")).first()[0] or 0) * s.tick_s
        kind = lambda df, k: df.withColumn("kind", F.lit(k))
        steps = kind(carried.drop("updated"), _CARRIED).unionByName(kind(solved, _FIX), allowMissingColumns=True)
        ordered = dealt(steps).sortWithinPartitions("device", "kind", "tick", "floor_seq")
        folded = work.keep(ordered.mapInPandas(_fold(floors, now, s), STEP), "live-steps")

        fixes = folded.filter(F.col("kind") == _FIX).select("device", "tick", "floor_seq", "x", "y", "raw_x", "raw_y", "rms_m", "conf", "floors")
        parts.write(tk.placed_in_zones(fixes, plan.zones, plan.subzones, s), "fixes", batch)
        parts.write(folded.filter(F.col("kind") == _PRUNED).select("device"), "pruned", batch)
        keys = ["device", "tick"]
        kept = gate.unionByName(new.drop("floor_seq")).repartition(n, *keys).join(newest.repartition(n, *keys), keys, "left_semi").filter(F.col("tick") * s.tick_s >= now - s.stale_s)
        parts.write(kept.select(*[c.split()[0] for c in GATE.split(", ")]), "gate", batch)
        parts.write(folded.filter(F.col("kind") == _CARRIED).select("device", "updated", "track"), "state", batch)
        for name in ("gate", "state"):
            parts.forget_replaced(name, batch)
        work.keep_only()

    def start(self, states: DataFrame, checkpoint: str, available_now: bool = False):
        writer = states.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.s.tick_s} seconds")).start()
