"""Which receivers are linked, silent, unmatched, offline; which devices hear what."""

from __future__ import annotations

import difflib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULTS, DISTANCE_PLATFORM, Settings
from ..functions import scalars as f
from ..sources.files import WorkTables
from .zones import small


def sensors_now(states: DataFrame) -> DataFrame:
    """The newest state of each sensor: entity_id, device, scanner, state, unit."""
    last = states.groupBy("entity_id").agg(F.max_by(F.struct("state", "unit"), F.struct("tick", "event_id")).alias("s"))
    return last.select("entity_id", f.device_of(F.col("entity_id")).alias("device"), f.scanner_of(F.col("entity_id")).alias("scanner"), "s.state", "s.unit")


def unmatched_placements(placed: DataFrame, sensors: DataFrame) -> DataFrame:
    """Placed receivers that no distance sensor names."""
    return placed.join(sensors.select("scanner"), "scanner", "left_anti")


def unplaced_scanners(sensors: DataFrame, placed: DataFrame) -> DataFrame:
    """Scanners with sensors but no placement: counts of sensors and of those with a reading."""
    free = sensors.join(placed.select("scanner"), "scanner", "left_anti")
    return free.groupBy("scanner").agg(F.count(F.lit(1)).alias("sensor_count"), F.count_if(f.has_reading(F.col("state"))).alias("reporting_count")).withColumn("token", f.scanner_token(F.col("scanner")))


def scanner_linking(placed: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each placed receiver with its sensors and its status: unmatched, live or silent."""
    per = sensors.groupBy("scanner").agg(
        F.count(F.lit(1)).alias("sensor_count"), F.count_if(f.has_reading(F.col("state"))).alias("reporting_count"),
        F.sort_array(F.collect_list(F.struct("device", "entity_id", "state"))).alias("sensors"),
    )
    j = placed.join(per, "scanner", "left")
    n, live = F.coalesce("sensor_count", F.lit(0)), F.coalesce("reporting_count", F.lit(0))
    status = F.when(n == 0, "unmatched").when(live > 0, "live").otherwise("silent")
    return j.select(*placed.columns, f.scanner_token(F.col("scanner")).alias("token"), status.alias("status"), n.alias("sensor_count"), live.alias("reporting_count"), "sensors")


def status_counts(linking: DataFrame) -> DataFrame:
    return linking.groupBy("floor").pivot("status", ["live", "silent", "unmatched"]).agg(F.count(F.lit(1))).na.fill(0)


def beacon_links(sensors: DataFrame) -> DataFrame:
    """Each device with the receivers that detect it, nearest first; a dark device keeps an empty list."""
    value = f.number(F.col("state"))
    heard = F.when(f.has_reading(F.col("state")) & value.isNotNull(), F.struct(f.metres(value, F.col("unit")).alias("metres"), "scanner", F.round(value, 2).alias("distance"), F.coalesce("unit", F.lit("m")).alias("unit")))
    return sensors.groupBy("device").agg(F.sort_array(F.collect_list(heard)).alias("receivers"))


#: Similarities at which candidates are looked for, one after the other; the last is the least that counts.
LEVELS = (0.9, 0.75, 0.65, 0.55)


def _letters(names: DataFrame, name: str) -> DataFrame:
    """name, n, sym: each letter with the number of its occurrence, so that common letters are a set's overlap."""
    letters = F.filter(F.split(F.col(name), ""), lambda c: c != "")
    counted = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda o: o == c)).cast("string")))
    return names.select(name, F.char_length(name).alias("n"), F.explode(counted).alias("sym"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, ratio of names (columns a of ``left``, b of ``right``) that are at least ``least`` similar; no pair is missed.

    Twice the common letters over all letters bounds the ratio. With k = least / (2 - least), a pair within the
    bound shares k n letters of each name of length n, so if letters are ordered from the rarest, the first
    n - ceil(k n) + 1 of both names share one: an equi-join on those finds every candidate. The ratio
    itself is computed for candidates alone, after the bound.
    """
    share = least / (2 - least)
    sides = _letters(left, "a"), _letters(right, "b")
    common = small(sides[0].select("sym").unionByName(sides[1].select("sym")).groupBy("sym").agg(F.count("*").alias("df")))

    def rare(rows: DataFrame, name: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(name).orderBy("df", "sym"))
        return rows.join(common, "sym").withColumn("at", at).filter(F.col("at") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).select("sym", name, F.col("n").alias(f"n_{name}"))

    met = rare(sides[0], "a").join(rare(sides[1], "b"), "sym").filter((F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b").distinct()

    def rate(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            m = difflib.SequenceMatcher(None, x, y)
            r = m.quick_ratio()
            out.append(m.ratio() if r >= least else r)
        return pa.array(out, pa.float64())

    return met.withColumn("ratio", F.arrow_udf(rate, "double")("a", "b")).filter(F.col("ratio") >= least)


def suggest(unmatched: DataFrame, free: DataFrame) -> DataFrame:
    """A scanner to re-link each unmatched placement to: a unique shared hardware token, else the most similar name (0.55 or more, of equals the first).

    Names are looked for at a high similarity first: whoever has one there needs no other, as the most similar
    is among those found. What is left goes on to the next level.
    """
    work = WorkTables()
    options = work.keep(free.select("scanner").distinct(), "relink-free")
    rows = work.keep(unmatched.select("scanner", F.coalesce("uid", f.scanner_token(F.col("scanner"))).alias("token")), "relink-rows")
    tokens = options.select(f.scanner_token(F.col("scanner")).alias("token"), F.col("scanner").alias("option")).groupBy("token").agg(F.min("option").alias("option"), F.max("option").alias("__last"))
    found = work.keep(rows.join(tokens.filter("token <> '' and option = __last"), "token").select("scanner", F.col("option").alias("suggested")).distinct(), "relink-found")
    left = work.keep(rows.select(F.col("scanner").alias("a")).distinct().join(found.select(F.col("scanner").alias("a")), "a", "left_anti"), "relink-left")
    for level in LEVELS:
        if left.isEmpty():
            break
        pairs = similar_pairs(left, options.select(F.col("scanner").alias("b")), level)
        best = work.keep(pairs.groupBy("a").agg(F.min(F.struct(-F.col("ratio"), "b"))["b"].alias("suggested")).select(F.col("a").alias("scanner"), "suggested"), "relink-found")
        after = work.keep(left.join(best.select(F.col("scanner").alias("a")), "a", "left_anti"), "relink-left")
        found, left = found.unionByName(best), after
    return rows.select("scanner").join(found, "scanner", "left")


def unique_slugs(devices: DataFrame) -> DataFrame:
    """slug, device_id: slugs that only one device has."""
    s = devices.select("device_id", f.slugify(F.coalesce("name_by_user", "name")).alias("slug")).filter("slug <> ''")
    return s.groupBy("slug").agg(F.min("device_id").alias("device_id"), F.max("device_id").alias("__last")).filter("device_id = __last").drop("__last")


def device_online(entities: DataFrame) -> DataFrame:
    """device_id, online: the first connectivity entity decides, else any entity that is not unavailable; null without a state."""
    known = entities.filter("state is not null")
    first = F.min_by("state", F.when(F.col("device_class") == "connectivity", F.col("entity_seq")))
    d = known.groupBy("device_id").agg(first.alias("__c"), F.bool_or(F.col("device_class") == "connectivity").alias("__has"), F.bool_or(F.col("state") != "unavailable").alias("__any"))
    return d.select("device_id", F.when(F.col("__has"), f.looks_online(F.col("__c"))).otherwise(F.col("__any")).alias("online"))


def _stretch(values: list[float]) -> list[tuple[float, float, float]]:
    """What a stretch of newest stamps makes of the stamp accepted before it: steps (above, below, leaves).

    The first step with above > stamp or below <= stamp - 60 leaves another one accepted; without one the
    stamp stays. From the back, each dump's next re-anchoring one is found among the highest and lowest
    stamps so far; steps in a row that leave the same are one.
    """
    ends: list[float] = [0.0] * len(values)
    high: list[tuple[float, int]] = []  # -stamp, place: nearest last, further ones higher
    low: list[tuple[float, int]] = []  # stamp, place: nearest last, further ones lower
    for i in range(len(values) - 1, -1, -1):
        v = values[i]
        if v != v:  # accepted whatever came before, and so is the next one
            ends[i] = ends[i + 1] if i + 1 < len(values) else v
            high, low = [(-math.inf, i)], [(-math.inf, i)]
            continue
        up, down = bisect_left(high, (-v, -1)) - 1, bisect_right(low, (v - 60, len(values))) - 1
        then = min([place for _, place in high[up:up + 1] * (up >= 0) + low[down:down + 1] * (down >= 0)], default=None)
        ends[i] = v if then is None else ends[then]
        while high and -high[-1][0] <= v:
            high.pop()
        while low and low[-1][0] >= v:
            low.pop()
        high.append((-v, i))
        low.append((v, i))
    steps: list[list[float]] = []
    for i, stamp, above in sorted([(i, -v, True) for v, i in high] + [(i, v, False) for v, i in low]):
        if not steps or steps[-1][2] != ends[i]:
            steps.append([-math.inf, math.inf, ends[i]])
        steps[-1][0 if above else 1] = stamp
    return [tuple(x) for x in steps]


def dump_ages(dumps: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Which dumps re-anchor the ages: source, dump, newest, anchored.

    A dump counts unless its newest stamp lies in the minute up to the last accepted one of its source. One
    row a dump (the newest stamp), sorted by source and dump, is cut into as many stretches as a shuffle has
    parts, wherever a source begins or ends; each stretch tells what it makes of any stamp accepted before
    it, a fold over a source's stretches finds which one that is, and then stretches are gone through on
    their own. However long one source's dumps are, no task holds them all.
    """
    spark, work = dumps.sparkSession, WorkTables()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    per = dumps.groupBy("source", "dump").agg(F.max("last_seen").cast("double").alias("newest"))
    per = work.keep(per.repartitionByRange(n, "source", "dump").withColumn("stretch", F.spark_partition_id()), "dump-stretches")
    columns = lambda df: ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, rows in runs(batches):
            above, below, leaves = zip(*_stretch([x for b in rows for x in b["newest"]]), strict=True)
            yield pd.DataFrame({"source": [key[0]], "stretch": [key[1]], "above": [list(above)], "below": [list(below)], "leaves": [list(leaves)]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, now = None, None
        for b in batches:
            before = []
            for key, *steps in zip(b["source"], b["above"], b["below"], b["leaves"], strict=True):
                now = None if key != source else now
                source = key
                before.append(now)
                fresh = now is None or now != now
                now = next((e for a, d, e in zip(*steps, strict=True) if fresh or a > now or d <= now - 60), now)
            yield b[["source", "stretch"]].assign(before=pd.array(before, dtype=object), first=[x is None for x in before])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in runs(batches):
            before = None
            for k, b in enumerate(rows):
                if not k and not b["first"].iloc[0]:
                    before = b["before"].iloc[0]
                out = []
                for newest in b["newest"]:
                    keep = not (before is not None and before - 60 < newest <= before)
                    before = newest if keep else before
                    out.append(keep)
                yield b[["source", "dump", "newest"]].assign(anchored=out)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
        """Batches of one source and stretch after the other."""
        pieces = ((key, piece) for b in batches for key, piece in b.groupby(["source", "stretch"], sort=False, dropna=False))
        for key, group in groupby(pieces, key=lambda x: x[0]):
            yield key, (piece for _, piece in group)

    ordered = lambda df: df.repartition("source", "stretch").sortWithinPartitions("source", "stretch", "dump")
    keys = columns(per.select("source", "stretch"))
    told = ordered(per).mapInPandas(tell, keys + ", above array<double>, below array<double>, leaves array<double>")
    entries = told.repartition("source").sortWithinPartitions("source", "stretch").mapInPandas(follow, keys + ", before double, first boolean")
    return ordered(per.join(entries.hint("merge"), ["source", "stretch"])).mapInPandas(run, columns(per.drop("stretch")) + ", anchored boolean")


def receiver_status(receivers: DataFrame, ages: DataFrame, status_sensors: DataFrame, devices: DataFrame, readings: DataFrame, override: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """scanner, online, tier: the first tier that resolves.

    ages (scanner, age), status_sensors (scanner, state, device_class), devices (scanner, online),
    readings (scanner); override (scanner, state), if given, is asked first.
    """
    j = receivers.select("scanner").join(ages, "scanner", "left")
    j = j.join(status_sensors.filter("device_class = 'connectivity'").select("scanner", F.col("state").alias("__s"), F.lit(True).alias("__has")), "scanner", "left")
    j = j.join(devices.select("scanner", F.col("online").alias("__d")), "scanner", "left").join(readings.select("scanner", F.lit(True).alias("__r")).distinct(), "scanner", "left")
    tiers = [F.when(F.col("age").isNotNull(), F.col("age") <= s.offline_s), F.when(F.col("__has"), f.looks_online(F.col("__s"))), F.col("__d"), F.coalesce("__r", F.lit(False))]
    if override is not None:
        j = j.join(override.select("scanner", F.col("state").alias("__o")), "scanner", "left")
        tiers.insert(0, F.when(F.col("__o").isNotNull(), f.looks_online(F.col("__o"))))
    tier = F.lit(len(tiers))
    for i in range(len(tiers) - 1, 0, -1):
        tier = F.when(tiers[i - 1].isNotNull(), i).otherwise(tier)
    return j.select("scanner", F.coalesce(*tiers).alias("online"), tier.alias("tier"))


def offline_in_panel(placed: DataFrame, reported: DataFrame, offline: DataFrame) -> DataFrame:
    """Placed receivers that are not reported or are listed as offline; none where no list is loaded."""
    up = reported.select("scanner").join(offline.select("scanner"), "scanner", "left_anti")
    loaded = reported.limit(1).select(F.lit(True).alias("__l"))
    return placed.select("scanner").join(up, "scanner", "left_anti").join(F.broadcast(loaded), how="cross").drop("__l")


def via_device(trackers: DataFrame, registry: DataFrame, devices: DataFrame, platform: str = DISTANCE_PLATFORM) -> DataFrame:
    """device, identifier: from the first own sensor of each tracker; the platform's identifier before others."""
    own = registry.filter((F.col("platform") == platform) & F.col("device_id").isNotNull()).withColumn("device", f.device_of(F.col("entity_id")))
    first = own.groupBy("device").agg(F.min_by("device_id", "entity_seq").alias("device_id"))
    d = devices.select("device_id", F.coalesce(F.get(F.filter("identifiers", lambda i: i["domain"] == platform), F.lit(0))["id"], F.get("identifiers", F.lit(0))["id"]).alias("identifier"))
    return trackers.select("device").join(first, "device").join(d, "device_id").select("device", "identifier")


def report_now(report: DataFrame, placed: DataFrame) -> DataFrame:
    """A calibration report against today's placements: scanner, status (still missing with its cause, or placed since)."""
    still = report.filter("cause is not null").join(placed.select("scanner"), "scanner", "left_semi").select("scanner", F.col("cause").alias("status"))
    since = placed.select("scanner").join(report.select("scanner"), "scanner", "left_anti").select("scanner", F.lit("placed_since").alias("status"))
    return still.unionByName(since)


def problem_order(linking: DataFrame) -> DataFrame:
    """Rows with problems first: unmatched, silent, live; then floor and id."""
    k = F.when(F.col("status") == "unmatched", 0).when(F.col("status") == "silent", 1).otherwise(2)
    rows = linking.withColumn("__k", k)
    # A place is the number of rows in earlier groups and the place in the own one: only counts meet in one task.
    counts = rows.groupBy("__k", "floor").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__k", "floor").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__k").alias("__bk"), F.col("floor").alias("__bf"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__k", "floor").orderBy("scanner"))
    j = rows.withColumn("__own", own).join(before, (F.col("__k") == F.col("__bk")) & F.col("floor").eqNullSafe(F.col("__bf")))
    return j.withColumn("place", (F.col("__before") + F.col("__own")).cast("int")).select(*linking.columns, "place")


def picker(sensors: DataFrame, placed: DataFrame, typed: str = "") -> DataFrame:
    """Unplaced scanners whose name contains what was typed."""
    free = sensors.select("scanner").distinct().join(placed.select("scanner"), "scanner", "left_anti")
    return free.filter(F.lower("scanner").contains(typed.strip().lower()))


def merge_floors(floors: DataFrame) -> DataFrame:
    """Floors of one normalised name joined: first name, first known scale, receivers once by id, zones one after the other.

    floors: floor_seq, floor, scale, receivers array<string>, zones array<string>.
    """
    rows = F.sort_array(F.collect_list(F.struct("floor_seq", "floor", "scale", "receivers", "zones")))
    per = floors.groupBy(f.normalized(F.col("floor")).alias("key")).agg(rows.alias("r"))
    scales = F.filter(F.transform("r", lambda x: x["scale"]), lambda v: v.isNotNull())
    return per.select(
        F.col("r")[0]["floor_seq"].alias("floor_seq"), F.col("r")[0]["floor"].alias("floor"), F.get(scales, F.lit(0)).alias("scale"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: x["receivers"]))).alias("receivers"), F.flatten(F.transform("r", lambda x: x["zones"])).alias("zones"),
    )


