"""Telemetry, a layout and recordings derived from the ``events`` and ``lineitem`` tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out over as many tasks as a shuffle has: a table of keys is one small file, so one task, however much is made of each row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def _receivers(ids: DataFrame) -> DataFrame:
    r = F.col("id")
    return ids.select(
        F.expr("cast(id div 4 as int)").alias("floor_seq"),
        F.concat(F.lit("f"), F.expr("id div 4")).alias("floor"),
        r.cast("int").alias("rec_seq"),
        F.concat(F.lit("rx"), r).alias("scanner"),
        (200 + (r % 2) * 1600).cast("double").alias("x"),
        (200 + F.expr("(id % 4) div 2") * 1000).cast("double").alias("y"),
        F.when(r % 3 == 0, 2.2).alias("height"),
        (F.lit(0.9) + F.lit(0.02) * (r % 12)).alias("correction"),
        F.lit(40.0).alias("scale"),
    )


def receivers(spark: SparkSession) -> DataFrame:
    """Twelve receivers, four on each of three floors: floor_seq, floor, rec_seq, scanner, x, y, height, correction, scale."""
    return _receivers(spark.range(12))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each supplier: a building of as many floors as it takes."""
    return _receivers(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hand-drawn rooms a floor, one for each part: floor_seq, floor, zone_seq, zone_id, zone, poly, no_go, ring.

    In two rows, with integer wobble; on every third floor the second row is shifted, so that its corners lie on walls.
    Rooms that are no polygon are stored row by row.
    """
    k, f = F.col("p_partkey"), F.expr("cast(p_partkey div 6 as int)")
    cx, cy = (k % 6) % 3, F.expr("(p_partkey % 6) div 3")
    shift = F.when(f % 3 == 0, cy * 100).otherwise(0)
    corner = lambda i: F.struct((cx * 204 + shift + (200 if i in (1, 2) else 0) + (k * (7 + i * 5)) % 9 - 4).cast("double").alias("x"), (cy * 154 + (150 if i in (2, 3) else 0) + (k * (11 + i * 3)) % 7 - 3).cast("double").alias("y"))
    ring = F.when(k % 2 == 1, F.array(*[corner(i) for i in range(4)])).otherwise(F.array(*[corner(i) for i in (0, 1, 3, 2)]))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        f.alias("floor_seq"), F.concat(F.lit("f"), f).alias("floor"), (k % 6).cast("int").alias("zone_seq"), F.concat(F.lit("z"), k).alias("zone_id"), F.concat(F.lit("room"), k).alias("zone"), (k % 2 == 1).alias("poly"), (k % 11 == 5).alias("no_go"), ring.alias("ring"),
    )


# name, floors, ring, drawn as a polygon, forbidden
ZONES = [
    (0, 0, "west", "200 200,900 200,200 1200,900 1200", False, False),
    (0, 1, "east", "950 200,1800 200,1800 1200,950 1200", True, False),
    (1, 0, "west", "200 200,900 200,900 1200,200 1200", True, False),
    (1, 1, "east", "950 200,1800 200,1800 1200,950 1200", True, False),
    (1, 2, "void", "1300 500,1600 500,1600 800,1300 800", True, True),
    (2, 0, "west", "200 200,900 200,900 1200,200 1200", True, False),
    (2, 1, "hall", "950 200,1800 200,1800 700,1400 700,1400 1200,950 1200", True, False),
]
SUBZONES = [(f, 0, "desk", "300 300,500 300,500 500,300 500", "west") for f in range(3)]


def _ring(text: str) -> str:
    points = ", ".join(f"named_struct('x', {float(x)}D, 'y', {float(y)}D)" for x, y in (p.split() for p in text.split(",")))
    return f"array({points})"


def zones(spark: SparkSession) -> DataFrame:
    """floor_seq, floor, zone_seq, zone_id, zone, poly, no_go, ring."""
    rows = ", ".join(f"named_struct('floor_seq', {f}, 'floor', 'f{f}', 'zone_seq', {k}, 'zone_id', 'z{f}{k}', 'zone', '{n}', 'poly', {str(p).lower()}, 'no_go', {str(g).lower()}, 'ring', {_ring(t)})" for f, k, n, t, p, g in ZONES)
    return spark.range(1).select(F.expr(f"inline(array({rows}))"))


def subzones(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"named_struct('floor_seq', {f}, 'floor', 'f{f}', 'sub_seq', {k}, 'sub_zone', '{n}', 'parent', '{p}', 'ring', {_ring(t)})" for f, k, n, t, p in SUBZONES)
    return spark.range(1).select(F.expr(f"inline(array({rows}))"))


#: Events of one task, some ten readings each: more events make more tasks, not larger ones.
EVENTS_A_TASK = 25_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that readings are dealt out to: as many as a shuffle has, or more where there are many events."""
    events = table(spark, sf_dir, "events").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-events // EVENTS_A_TASK))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, device, tick, true_x, true_y, true_floor; one tick a second."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # An explicit number: what follows makes twelve rows of each, so small partitions must not be merged.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").repartition(tasks(spark, sf_dir), "user_id").withColumn("tick", F.row_number().over(order))
    u, t = F.col("user_id"), F.col("tick")
    return e.select(
        "event_id",
        u.alias("device"),
        "tick",
        F.col("ts").cast("timestamp").alias("ts"),
        (200 + (u * 131 + t * 17) % 1600).alias("true_x"),
        (200 + (u * 71 + t * 11) % 1000).alias("true_y"),
        (u % 3).cast("int").alias("true_floor"),
    )


#: Where telemetry that was written once is read from, a folder for each scale.
TELEMETRY = "spatiotrack.telemetry"


def write_telemetry(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the telemetry of one scale, as a tracking system would have it in store, and read it from there from now on."""
    derive_states(spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/{sf_dir.strip('/').replace('/', '-')}")
    spark.conf.set(TELEMETRY, folder)


def sensor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry stream: event_id, tick, ts, entity_id, state (text), unit; derived from events unless it was written before."""
    folder = spark.conf.get(TELEMETRY, None)
    return spark.read.parquet(f"{folder}/{sf_dir.strip('/').replace('/', '-')}") if folder else derive_states(spark, sf_dir)


def derive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.broadcast(receivers(spark).select("rec_seq", "floor_seq", "x", "y", "height", "correction"))
    j = truth(spark, sf_dir).join(r, (F.col("event_id") + F.col("rec_seq") * 7) % 5 != 0)
    dx, dy = F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y")
    up = 3 * (F.col("floor_seq") - F.col("true_floor")) + F.coalesce("height", F.lit(1.0)) - 1.0
    slant = F.sqrt((dx * dx + dy * dy) / F.lit(1600.0) + up * up)
    noise = 1 + ((F.col("event_id") * 7919 + F.col("rec_seq") * 104729) % 201 - 100) / F.lit(1000.0)
    slab = 1 + F.lit(0.3) * F.abs(F.col("floor_seq") - F.col("true_floor"))
    feet = F.col("rec_seq") % 4 == 3
    value = slant * slab * noise / F.col("correction") / F.when(feet, 0.3048).otherwise(1.0)
    j = j.withColumn("milli", F.round(value * 1000).cast("long"))
    text = F.concat(F.expr("milli div 1000").cast("string"), F.lit("."), F.lpad((F.col("milli") % 1000).cast("string"), 3, "0"))
    state = F.when(F.col("event_id") % 97 == 0, "unknown").when(F.col("event_id") % 101 == 0, "unavailable").otherwise(text)
    made = F.struct(
        "event_id", "tick", "ts",
        F.concat(F.lit("sensor.dev"), "device", F.lit("_distance_to_rx"), "rec_seq").alias("entity_id"),
        state.alias("state"),
        F.when(feet, "ft").otherwise("m").alias("unit"),
    )
    # One row as an array of one: filters on what is made stop here. Pushed below, they would hold all of its making once
    # more for each use, in a method too long for the JVM to compile.
    return j.select(F.inline(F.array(made)))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, platform: one row for each sensor."""
    from ..constants import DISTANCE_PLATFORM

    users = table(spark, sf_dir, "events").select("user_id").distinct()
    r = F.broadcast(receivers(spark).select("rec_seq"))
    other = (F.col("rec_seq") == 11) & (F.col("user_id") % 7 == 0)
    return users.join(r, how="cross").select(
        F.concat(F.lit("sensor.dev"), "user_id", F.lit("_distance_to_rx"), "rec_seq").alias("entity_id"), F.when(other, "template").otherwise(DISTANCE_PLATFORM).alias("platform")
    )


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes around the true position: ent, tick, updated, x, y, raw_x, raw_y, floor, floor_seq, zone, rms_m, conf."""
    e = F.col("event_id")
    seq = F.when(e % 29 == 0, (F.col("true_floor") + 1) % 3).otherwise(F.col("true_floor"))
    return truth(spark, sf_dir).select(
        F.concat(F.lit("dev"), "device").alias("ent"),
        "event_id",
        "tick",
        F.col("tick").cast("double").alias("updated"),
        (F.col("true_x") + (e * 37) % 401 - 200).cast("double").alias("x"),
        (F.col("true_y") + (e * 53) % 301 - 150).cast("double").alias("y"),
        (F.col("true_x") + (e * 41) % 601 - 300).cast("double").alias("raw_x"),
        (F.col("true_y") + (e * 59) % 501 - 250).cast("double").alias("raw_y"),
        seq.cast("int").alias("floor_seq"),
        F.concat(F.lit("f"), seq).alias("floor"),
        F.when(e % 7 == 0, "unknown").when((F.col("true_x") < 900), "west").otherwise("east").alias("zone"),
        ((e % 50) / 10.0).alias("rms_m"),
        ((e * 13 % 100) / 100.0).alias("conf"),
        F.col("true_x").cast("double").alias("true_x"),
        F.col("true_y").cast("double").alias("true_y"),
    )


def calibration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe-to-probe distances: tx, rx, seq, distance_m, with a planted bias of each receiver."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    li = table(spark, sf_dir, "lineitem").select(*keys)
    li = li.withColumn("tx", (F.col("l_suppkey") % 12).cast("int")).withColumn("rx", (F.col("l_partkey") % 12).cast("int"))
    li = li.filter((F.col("tx") != F.col("rx")) & (F.expr("tx div 4") == F.expr("rx div 4")))
    per = Window.partitionBy("tx", "rx").orderBy(*keys)
    li = li.withColumn("seq", F.row_number().over(per))
    r = receivers(spark)
    a = F.broadcast(r.select(F.col("rec_seq").alias("tx"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height").alias("ah")))
    b = F.broadcast(r.select(F.col("rec_seq").alias("rx"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height").alias("bh")))
    j = li.join(a, "tx").join(b, "rx")
    dx, dy = (F.col("ax") - F.col("bx")) / 40.0, (F.col("ay") - F.col("by")) / 40.0
    dh = F.coalesce(F.col("ah") - F.col("bh"), F.lit(0.0))
    true_m = F.sqrt(dx * dx + dy * dy + dh * dh)
    bias = 1 + F.lit(0.05) * (F.col("rx") % 4 - 1)
    noise = 1 + ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 41 - 20) / F.lit(1000.0)
    return j.select(F.concat(F.lit("rx"), "tx").alias("tx"), F.concat(F.lit("rx"), "rx").alias("rx"), "seq", (true_m * bias * noise).alias("distance_m"))
