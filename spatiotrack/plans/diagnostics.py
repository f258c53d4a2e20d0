"""Queries of diagnostics, liveness, links and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as f
from ..operators import calibration as cal
from ..operators import diagnostics as dg
from ..operators import links as lk
from ..sources import fixtures as fx
from .common import STATES, SUPPLIED, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# Placements: the fixture's receivers without rx7, and two whose names match no sensor.
PLACED = ", pl AS (SELECT floor, scanner, CAST(NULL AS VARCHAR) AS uid FROM rec WHERE scanner <> 'rx7' UNION ALL SELECT 'f0', 'old_probe_a1b2c3', NULL UNION ALL SELECT 'f2', 'rx70', NULL)"
NOW = STATES + PLACED + ", sn AS (SELECT entity_id, arg_max(state, struct_pack(a := tick, b := event_id)) AS state, arg_max(unit, struct_pack(a := tick, b := event_id)) AS unit FROM st GROUP BY 1), sx AS (SELECT *, regexp_replace(split_part(entity_id, '_distance_to_', 1), '^sensor\\.', '') AS device, split_part(entity_id, '_distance_to_', 2) AS scanner, state NOT IN ('', 'unknown', 'unavailable') AS live FROM sn)"


def _placed(spark):
    none = F.lit(None).cast("string").alias("uid")
    a = fx.receivers(spark).filter("scanner <> 'rx7'").select("floor", "scanner", none)
    b = spark.range(2).select(F.when(F.col("id") == 0, "f0").otherwise("f2").alias("floor"), F.when(F.col("id") == 0, "old_probe_a1b2c3").otherwise("rx70").alias("scanner"), none)
    return a.unionByName(b)


def _sensors(spark, sf):
    return dg.sensors_now(fx.sensor_states(spark, sf))


@query(sql(NOW, "SELECT floor, scanner FROM pl WHERE scanner NOT IN (SELECT scanner FROM sx)"))
def j4_unmatched(spark, sf):
    return dg.unmatched_placements(_placed(spark), _sensors(spark, sf)).select("floor", "scanner")


@query(sql(NOW, "SELECT scanner, count(*) AS sensor_count, count(*) FILTER (live) AS reporting_count FROM sx WHERE scanner NOT IN (SELECT scanner FROM pl) GROUP BY 1"))
def j5_unplaced(spark, sf):
    return dg.unplaced_scanners(_sensors(spark, sf), _placed(spark)).select("scanner", "sensor_count", "reporting_count")


@query(sql(NOW + ", p AS (SELECT scanner, count(*) AS n, count(*) FILTER (live) AS r FROM sx GROUP BY 1)", "SELECT floor, pl.scanner, CASE WHEN n IS NULL THEN 'unmatched' WHEN r > 0 THEN 'live' ELSE 'silent' END AS status, coalesce(n, 0) AS sensor_count, coalesce(r, 0) AS reporting_count FROM pl LEFT JOIN p USING (scanner)"))
def j6_linking(spark, sf):
    return dg.scanner_linking(_placed(spark), _sensors(spark, sf)).select("floor", "scanner", "status", "sensor_count", "reporting_count")


@query(sql(NOW + ", v AS (SELECT *, try_cast(state AS DOUBLE) * CASE WHEN unit = 'ft' THEN 0.3048e0 ELSE 1e0 END AS m FROM sx)", "SELECT device, coalesce(string_agg(scanner, ',' ORDER BY m, scanner) FILTER (m IS NOT NULL), '') AS nearest_first FROM v GROUP BY 1"))
def j7_beacons(spark, sf):
    b = dg.beacon_links(_sensors(spark, sf))
    return b.select("device", F.array_join(F.transform("receivers", lambda r: r["scanner"]), ",").alias("nearest_first"))


@query(sql(NOW, "SELECT floor, count(*) FILTER (scanner IN (SELECT scanner FROM sx WHERE live)) AS live, count(*) FILTER (scanner IN (SELECT scanner FROM sx) AND scanner NOT IN (SELECT scanner FROM sx WHERE live)) AS silent, count(*) FILTER (scanner NOT IN (SELECT scanner FROM sx)) AS unmatched FROM pl GROUP BY 1"))
def a18_status_counts(spark, sf):
    return dg.status_counts(dg.scanner_linking(_placed(spark), _sensors(spark, sf)))


@query(sql(NOW + ", p AS (SELECT scanner, bool_or(live) AS r FROM sx GROUP BY 1)", "SELECT floor, pl.scanner, CAST(row_number() OVER (ORDER BY CASE WHEN r IS NULL THEN 0 WHEN NOT r THEN 1 ELSE 2 END, floor, pl.scanner) AS INTEGER) AS place FROM pl LEFT JOIN p USING (scanner)"))
def l8_problem_order(spark, sf):
    return dg.problem_order(dg.scanner_linking(_placed(spark), _sensors(spark, sf))).select("floor", "scanner", "place")


@query(sql(NOW, "SELECT DISTINCT scanner FROM sx WHERE scanner NOT IN (SELECT scanner FROM pl) AND contains(scanner, 'x')"))
def l9_picker(spark, sf):
    return dg.picker(_sensors(spark, sf), _placed(spark), " X")


@query(sql(NOW, "SELECT list_aggregate(list_sort(list(DISTINCT device)), 'string_agg', ',') AS devices, list_aggregate(list_sort(list(DISTINCT scanner)), 'string_agg', ',') AS scanners FROM sx"))
def l4_sorted_lists(spark, sf):
    s = _sensors(spark, sf)
    return s.agg(F.array_join(F.sort_array(F.collect_set("device")), ",").alias("devices"), F.array_join(F.sort_array(F.collect_set("scanner")), ",").alias("scanners"))


@query()
def p15_suggested_links(spark, sf):
    s, p = _sensors(spark, sf), _placed(spark)
    return dg.suggest(dg.unmatched_placements(p, s), dg.unplaced_scanners(s, p))


# Names and addresses from the customer table.
NAMES = "nm AS (SELECT c_custkey AS k, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Den/Büro' WHEN 1 THEN '__Hall' ELSE '' END AS name, 'probe_' || CASE WHEN c_custkey % 3 = 0 THEN 'ZZ' ELSE '' END || lpad(printf('%x', (c_custkey * 7919) % 16777216), 6, '0') AS slug, 'AA:BB:CC:' || upper(substr(h, 1, 2)) || ':' || upper(substr(h, 3, 2)) || ':' || upper(substr(h, 5, 2)) AS mac FROM (SELECT *, lpad(printf('%x', (c_custkey * 7919 + c_custkey % 6) % 16777216), 6, '0') AS h FROM customer))"


def _names(spark, sf):
    k = F.col("c_custkey")
    hexa = lambda c: F.lpad(F.lower(F.hex(c)), 6, "0")
    h = hexa((k * 7919 + k % 6) % 16777216)
    part = lambda i: F.upper(F.substring(h, i, 2))
    c = fx.table(spark, sf, "customer")
    return c.select(
        k.alias("k"), F.concat("c_name", F.when(k % 4 == 0, " Den/Büro").when(k % 4 == 1, "__Hall").otherwise("")).alias("name"),
        F.concat(F.lit("probe_"), F.when(k % 3 == 0, "ZZ").otherwise(""), hexa((k * 7919) % 16777216)).alias("slug"),
        F.concat(F.lit("AA:BB:CC:"), part(1), F.lit(":"), part(3), F.lit(":"), part(5)).alias("mac"),
    )


@query(sql(NAMES, "SELECT k, lower(trim(name)) AS key FROM nm"))
def p8_normalized(spark, sf):
    return _names(spark, sf).select("k", f.normalized(F.concat(F.lit(" \t"), "name", F.lit("\n"))).alias("key"))


@query(sql(NAMES, "SELECT k, CASE WHEN regexp_full_match(lower(split_part(slug, '_', 2)), '[0-9a-f]{5,12}') THEN lower(split_part(slug, '_', 2)) END AS token FROM nm"))
def p9_scanner_token(spark, sf):
    return _names(spark, sf).select("k", f.scanner_token(F.col("slug")).alias("token"))


@query(sql(NAMES, "SELECT k, right(regexp_replace(lower(mac), '[^0-9a-f]', '', 'g'), 6) AS tail FROM nm"))
def p10_address_tail(spark, sf):
    return _names(spark, sf).select("k", f.address_tail(F.col("mac")).alias("tail"))


@query(sql(NAMES + ", t AS (SELECT k, right(slug, 6) AS tok, right(regexp_replace(lower(mac), '[^0-9a-f]', '', 'g'), 6) AS tail FROM nm)", "SELECT k, left(tok, 4) = left(tail, 4) AND (CAST('0x' || right(tail, 2) AS INTEGER) - CAST('0x' || right(tok, 2) AS INTEGER) + 256) % 256 <= 3 AS same FROM t"))
def p11_token_match(spark, sf):
    return _names(spark, sf).select("k", f.token_matches(F.right("slug", F.lit(6)), F.col("mac")).alias("same"))


# Tokens as users type them: upper case, too short, with letters that are no hexadecimal digits.
TYPED = NAMES + ", tp AS (SELECT k, mac, CASE k % 5 WHEN 0 THEN upper(right(slug, 6)) WHEN 1 THEN left(right(slug, 6), 4) || 'zz' WHEN 2 THEN right(slug, 5) WHEN 3 THEN NULL ELSE 'id-' || upper(right(slug, 6)) END AS token FROM nm), tm AS (SELECT k, lower(right(token, 6)) AS tok, right(regexp_replace(lower(mac), '[^0-9a-f]', '', 'g'), 6) AS tail FROM tp)"


@query(sql(TYPED, "SELECT k, CASE WHEN regexp_full_match(tok, '[0-9a-f]{6}') THEN left(tok, 4) = left(tail, 4) AND (CAST('0x' || right(tail, 2) AS INTEGER) - CAST('0x' || right(tok, 2) AS INTEGER) + 256) % 256 <= 3 ELSE false END AS same FROM tm"))
def p11b_typed_tokens(spark, sf):
    k, tok = F.col("k"), F.right("slug", F.lit(6))
    typed = F.when(k % 5 == 0, F.upper(tok)).when(k % 5 == 1, F.concat(F.left(tok, F.lit(4)), F.lit("zz"))).when(k % 5 == 2, F.right("slug", F.lit(5))).when(k % 5 == 4, F.concat(F.lit("id-"), F.upper(tok)))
    return _names(spark, sf).select("k", f.token_matches(typed, F.col("mac")).alias("same"))


# Scanners by supplier: names in step, renamed with a hardware token in the slug, or a typed token; every fourth has none that fits.
SCANNERS = """
sc AS (SELECT s_suppkey AS k, printf('%06x', s_suppkey * 16) AS tail FROM supplier),
pm AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'probe_buro_' || k WHEN k % 4 = 1 THEN 'old_' || k || '_' || printf('%06x', k * 16 - k % 3) ELSE 'room_' || k END AS slug,
  CASE WHEN k % 4 = 2 THEN upper(printf('%06x', k * 16 - k % 3)) WHEN k % 4 = 3 THEN 'zz' || printf('%04x', k) END AS uid, 'aa:bb:cc:' || tail[1:2] || ':' || tail[3:4] || ':' || tail[5:6] AS address FROM sc)"""


def _scanners(spark, sf):
    k = F.col("s_suppkey")
    hexa = lambda c, n=6: F.lpad(F.lower(F.hex(c)), n, "0")
    tail = hexa(k * 16)
    part = lambda i: F.upper(F.substring(tail, i, 2))
    s = fx.table(spark, sf, "supplier")
    scanners = s.select(F.concat(F.lit("AA:BB:CC:"), part(1), F.lit(":"), part(3), F.lit(":"), part(5)).alias("address"), F.concat(F.lit("Probe Büro "), k).alias("name"))
    near = hexa(k * 16 - k % 3)
    slug = F.when(k % 4 == 0, F.concat(F.lit("probe_buro_"), k)).when(k % 4 == 1, F.concat(F.lit("old_"), k, F.lit("_"), near)).otherwise(F.concat(F.lit("room_"), k))
    uid = F.when(k % 4 == 2, F.upper(near)).when(k % 4 == 3, F.concat(F.lit("zz"), hexa(k, 4)))
    return s.select(slug.alias("slug"), uid.alias("uid")), scanners


@query(sql(SCANNERS, "SELECT slug, address, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS tier FROM pm WHERE k % 4 <> 3"))
def j8_match_scanners(spark, sf):
    return cal.match_scanners(*_scanners(spark, sf)).select("slug", "address", "tier")


@query(sql(NAMES, "SELECT k, regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM nm"))
def p12_slugify(spark, sf):
    return _names(spark, sf).select("k", f.slugify(F.col("name")).alias("slug"))


@query(sql("v AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN ' Off ' WHEN 2 THEN 'on' WHEN 3 THEN 'NO' WHEN 4 THEN '' WHEN 5 THEN 'Disconnected' WHEN 6 THEN '12.5' WHEN 7 THEN 'unknown' ELSE 'not_home' END AS s FROM events)", "SELECT event_id, coalesce(lower(trim(s)) NOT IN ('', 'unavailable', 'unknown', 'none', 'off', 'false', 'not_home', 'offline', 'disconnected', 'no'), false) AS online, coalesce(s, '') NOT IN ('', 'unknown', 'unavailable') AS reading FROM v"))
def p13_online_states(spark, sf):
    e = F.col("event_id") % 9
    s = F.when(e == 0, F.lit(None)).when(e == 1, " Off ").when(e == 2, "on").when(e == 3, "NO").when(e == 4, "").when(e == 5, "Disconnected").when(e == 6, "12.5").when(e == 7, "unknown").otherwise("not_home")
    v = fx.table(spark, sf, "events").select("event_id", s.alias("s"))
    return v.select("event_id", f.looks_online(F.col("s")).alias("online"), f.has_reading(F.col("s")).alias("reading"))


@query(sql("v AS (SELECT event_id, (event_id % 4001) / 100e0 AS m FROM events)", "SELECT event_id, printf('%.1f', CASE WHEN event_id % 4001 % 50 = 25 THEN m + 0.01e0 ELSE m END) || ' m' AS label FROM v"))
def p28b_distance_label_all(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", f.distance_label((F.col("event_id") % 4001) / 100.0).alias("label"))


@query(sql("v AS (SELECT event_id, (event_id % 301 - 150) / 100e0 AS p, event_id % 8 = 0 AS stale FROM events), h AS (SELECT *, 240 - (greatest(-1e0, least(1e0, p)) + 1) * 120 AS hue FROM v)", "SELECT event_id, hue, CASE WHEN stale THEN 'stale' WHEN hue < 90 THEN 'red' WHEN hue > 150 THEN 'blue' ELSE 'green' END AS band FROM h"))
def p29_error_colour(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("hue", f.error_hue((F.col("event_id") % 301 - 150) / 100.0))
    return e.select("event_id", "hue", f.error_band(F.col("hue"), F.col("event_id") % 8 == 0).alias("band"))


@query(sql("v AS (SELECT DISTINCT CAST(event_id % 500 AS INTEGER) AS i FROM events)", "SELECT i, CAST(round((i * 137.508e0) % 360) AS INTEGER) % 360 AS hue FROM v"))
def p30_golden_hue(spark, sf):
    e = fx.table(spark, sf, "events").select((F.col("event_id") % 500).cast("int").alias("i")).distinct()
    return e.select("i", f.golden_hue(F.col("i")).alias("hue"))


@query(sql("v AS (SELECT DISTINCT CAST(event_id % 90 + 1 AS INTEGER) AS i FROM events)", "SELECT i, CAST(least(7, floor((i - 1) / 90e0 * 8)) AS INTEGER) AS bucket FROM v"))
def p31_recency_bucket(spark, sf):
    e = fx.table(spark, sf, "events").select((F.col("event_id") % 90 + 1).cast("int").alias("i")).distinct()
    return e.select("i", f.recency_bucket(F.col("i"), F.lit(91)).alias("bucket"))


@query(sql("v AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0e0 ELSE 10e0 + event_id % 90 END AS scale, (1 + event_id % 17) / 8e0 AS zoom, event_id % 2 = 1 AS feet FROM events), u AS (SELECT *, CASE WHEN feet THEN scale * 0.3048e0 ELSE scale END AS unit FROM v)", "SELECT event_id, CASE WHEN scale > 0 THEN CAST(greatest(1, ceil(45e0 / (unit * zoom))) AS INTEGER) END AS units, CASE WHEN scale > 0 THEN round(greatest(1, ceil(45e0 / (unit * zoom))) * unit, 6) END AS px FROM u"))
def p32_grid_step(spark, sf):
    e = F.col("event_id")
    scale = F.when(e % 13 == 0, 0.0).otherwise(10.0 + e % 90)
    step = f.grid_step(scale, (1 + e % 17) / 8.0, e % 2 == 1)
    return fx.table(spark, sf, "events").select("event_id", step["units"].alias("units"), F.round(step["px"], 6).alias("px"))


@query(sql("v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sensor.phone' || event_id || '_phone' || event_id || '_bps_zone' WHEN 1 THEN 'sensor.a_b_a_b_bps_floor' WHEN 2 THEN 'sensor.phone_bps_zone' ELSE 'sensor.phone_phone_bps_sub_zone' END AS id FROM events)", "SELECT event_id, event_id % 4 < 2 AS legacy FROM v"))
def p33_legacy_ids(spark, sf):
    e = F.col("event_id")
    i = F.when(e % 4 == 0, F.concat(F.lit("sensor.phone"), e, F.lit("_phone"), e, F.lit("_bps_zone"))).when(e % 4 == 1, "sensor.a_b_a_b_bps_floor").when(e % 4 == 2, "sensor.phone_bps_zone").otherwise("sensor.phone_phone_bps_sub_zone")
    return fx.table(spark, sf, "events").select("event_id", f.legacy_id(i).alias("legacy"))


# Devices of the supplier table, some names used twice.
DEVICES = "dv AS (SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Probe ' || (s_suppkey // 20) ELSE s_name END AS name FROM supplier)"


@query(sql(DEVICES + ", s AS (SELECT device_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM dv)", "SELECT slug, min(device_id) AS device_id FROM s GROUP BY 1 HAVING count(DISTINCT device_id) = 1"))
def j18_unique_slugs(spark, sf):
    k = F.col("s_suppkey")
    d = fx.table(spark, sf, "supplier").select(k.alias("device_id"), F.lit(None).cast("string").alias("name_by_user"), F.when(k % 10 == 0, F.concat(F.lit("Probe "), F.expr("s_suppkey div 20"))).otherwise(F.col("s_name")).alias("name"))
    return dg.unique_slugs(d)


ENTITIES = "en AS (SELECT event_id AS entity_seq, user_id AS device_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unavailable' WHEN 2 THEN 'on' WHEN 3 THEN 'off' WHEN 4 THEN 'unavailable' ELSE 'unavailable' END AS state, CASE WHEN event_id % 37 = 0 THEN 'connectivity' ELSE 'distance' END AS device_class FROM events WHERE event_id % 6 <> 2 OR user_id % 3 = 0)"


def _entities(spark, sf):
    e = F.col("event_id")
    rows = fx.table(spark, sf, "events").filter((e % 6 != 2) | (F.col("user_id") % 3 == 0))
    state = F.when(e % 6 == 0, F.lit(None)).when(e % 6 == 1, "unavailable").when(e % 6 == 2, "on").when(e % 6 == 3, "off").otherwise("unavailable")
    return rows.select(e.alias("entity_seq"), F.col("user_id").alias("device_id"), state.alias("state"), F.when(e % 37 == 0, "connectivity").otherwise("distance").alias("device_class"))


@query(sql(ENTITIES + ", k AS (SELECT * FROM en WHERE state IS NOT NULL), c AS (SELECT device_id, arg_min(state, entity_seq) AS s FROM k WHERE device_class = 'connectivity' GROUP BY 1), a AS (SELECT device_id, bool_or(state <> 'unavailable') AS o FROM k GROUP BY 1)", "SELECT device_id, CASE WHEN s IS NOT NULL THEN s NOT IN ('unavailable', 'off') ELSE o END AS online FROM a LEFT JOIN c USING (device_id)"))
def a20_device_online(spark, sf):
    return dg.device_online(_entities(spark, sf))


# Dumps of eight installations, each with a clock of its own.
DUMPS = "dp AS (SELECT (event_id // 100) % 8 AS source, event_id // 100 AS dump, ((event_id // 100) * 37 % 90) * 10e0 + event_id % 7 AS last_seen FROM events), nw AS (SELECT source, dump, max(last_seen) AS newest, row_number() OVER (PARTITION BY source ORDER BY dump) AS n FROM dp GROUP BY 1, 2)"


@query(sql(DUMPS + ", k AS (SELECT source, dump, newest, n, true AS anchored, newest AS prev FROM nw WHERE n = 1 UNION ALL SELECT nw.source, nw.dump, nw.newest, nw.n, NOT (k.prev - 60 < nw.newest AND nw.newest <= k.prev), CASE WHEN k.prev - 60 < nw.newest AND nw.newest <= k.prev THEN k.prev ELSE nw.newest END FROM k JOIN nw ON nw.source = k.source AND nw.n = k.n + 1)", "SELECT source, CAST(dump AS BIGINT) AS dump, newest, anchored FROM k", recursive=True))
def st11_dump_ages_by_source(spark, sf):
    e = F.col("event_id")
    dump = F.expr("event_id div 100")
    d = fx.table(spark, sf, "events").select((dump % 8).alias("source"), dump.alias("dump"), ((dump * 37 % 90) * 10.0 + e % 7).alias("last_seen"))
    return dg.dump_ages(d)


# The same dumps from one installation: one clock, one chain over all of them.
CLOCK = "dp AS (SELECT event_id // 100 AS dump, ((event_id // 100) * 37 % 90) * 10e0 + event_id % 7 AS last_seen FROM events), nw AS (SELECT dump, max(last_seen) AS newest, row_number() OVER (ORDER BY dump) AS n FROM dp GROUP BY 1)"


@query(sql(CLOCK + ", k AS (SELECT dump, newest, n, true AS anchored, newest AS prev FROM nw WHERE n = 1 UNION ALL SELECT nw.dump, nw.newest, nw.n, NOT (k.prev - 60 < nw.newest AND nw.newest <= k.prev), CASE WHEN k.prev - 60 < nw.newest AND nw.newest <= k.prev THEN k.prev ELSE nw.newest END FROM k JOIN nw ON nw.n = k.n + 1)", "SELECT CAST(dump AS BIGINT) AS dump, newest, anchored FROM k", recursive=True))
def st11_dump_ages(spark, sf):
    dump = F.expr("event_id div 100")
    d = fx.table(spark, sf, "events").select(F.lit(0).alias("source"), dump.alias("dump"), ((dump * 37 % 90) * 10.0 + F.col("event_id") % 7).alias("last_seen"))
    return dg.dump_ages(d).select("dump", "newest", "anchored")


# Dumps of seven installations every fifteen seconds; every sixth hears nothing new, and clocks are reset every forty.
ALIVE = """dv AS (SELECT (event_id // 20) % 7 AS source, (event_id // 20) // 7 AS n, 'rx' || (user_id % 12) AS scanner, event_id FROM events),
ds AS (SELECT source, n, scanner, max(2000e0 + (n - CASE WHEN n % 6 = 3 THEN 1 ELSE 0 END) * 15 - CASE WHEN (n // 40) % 2 = 1 THEN 900 ELSE 0 END - event_id * 7 % 50) AS last_seen FROM dv GROUP BY ALL),
nw AS (SELECT source, n, max(last_seen) AS newest FROM ds GROUP BY ALL),
k AS (SELECT source, n, newest AS prev, true AS anchored FROM nw WHERE n = 0
  UNION ALL SELECT nw.source, nw.n, CASE WHEN k.prev - 60 < nw.newest AND nw.newest <= k.prev THEN k.prev ELSE nw.newest END, NOT (k.prev - 60 < nw.newest AND nw.newest <= k.prev) FROM k JOIN nw ON nw.source = k.source AND nw.n = k.n + 1),
an AS (SELECT source, n, prev AS newest, 1000 + 15e0 * n + source AS moment, lead(n) OVER w AS next_n, lead(1000 + 15e0 * n + source) OVER w AS next_moment, (SELECT 1000 + 15e0 * max(n) + k.source FROM nw WHERE nw.source = k.source) AS last_moment FROM k WHERE anchored WINDOW w AS (PARTITION BY source ORDER BY n)),
ag AS (SELECT an.*, scanner, newest - last_seen AS age FROM an JOIN ds USING (source, n)),
ch AS (SELECT source, scanner, moment, 0 AS o, age <= 30 AS online FROM ag
  UNION ALL SELECT source, scanner, moment + 30 - age, 1, false FROM ag WHERE age <= 30 AND moment + 30 - age < coalesce(next_moment, last_moment)
  UNION ALL SELECT source, scanner, next_moment, 0, NULL FROM ag WHERE next_n IS NOT NULL AND (source, next_n, scanner) NOT IN (SELECT (source, n, scanner) FROM ds)),
lg AS (SELECT *, row_number() OVER w AS i, lag(online) OVER w AS before FROM ch WINDOW w AS (PARTITION BY source, scanner ORDER BY moment, o))"""


@query(sql(ALIVE, "SELECT CAST(source AS VARCHAR) AS source, scanner, moment, online FROM lg WHERE i = 1 OR online IS DISTINCT FROM before", recursive=True))
def st11_liveness(spark, sf):
    """Receivers that go quiet, come back or leave, from a stream of dumps that comes in three parts."""
    from ..sources.files import work_folder
    from ..streaming.liveness import OUT, liveness_stream
    from ..streaming.tracker import run_to_end

    e, n = F.col("event_id"), F.expr("(event_id div 20) div 7")
    clock = 2000.0 + (n - F.when(n % 6 == 3, 1).otherwise(0)) * 15 - F.when(F.expr("((event_id div 20) div 7) div 40 % 2 = 1"), 900).otherwise(0)
    source = F.expr("(event_id div 20) % 7")
    dumps = fx.table(spark, sf, "events").select(source.cast("string").alias("source"), F.timestamp_seconds(1000 + n * 15 + source).alias("ts"), F.concat(F.lit("rx"), F.col("user_id") % 12).alias("scanner"), (clock - e * 7 % 50).alias("last_seen"), n.alias("n"))
    folder, sink = work_folder(spark, "dumps"), work_folder(spark, "liveness")
    last = dumps.agg(F.max("n")).first()[0] or 0
    for k in range(3):
        dumps.filter(F.expr(f"n * 3 div {last + 1} = {k}")).drop("n").write.mode("append").parquet(folder)
        run_to_end(liveness_stream(spark.readStream.schema(dumps.drop("n").schema).parquet(folder)), sink, sink + "-state")
    return spark.read.schema(OUT).parquet(sink).withColumnRenamed("at", "moment")


@query(sql(DUMPS, "SELECT CAST(dump AS BIGINT) AS dump, newest FROM nw"))
def a15_newest_stamp(spark, sf):
    d = fx.table(spark, sf, "events").select(F.expr("event_id div 100").alias("dump"), ((F.expr("event_id div 100") * 37 % 90) * 10.0 + F.col("event_id") % 7).alias("last_seen"))
    return d.groupBy("dump").agg(F.max("last_seen").alias("newest"))


TIERS = SUPPLIED + ", tk AS (SELECT scanner, rec_seq % 12 AS k FROM rec), tg AS (SELECT scanner, k, CASE WHEN k % 4 = 0 THEN k * 8e0 END AS age, CASE WHEN k % 4 = 1 THEN CASE WHEN k < 6 THEN 'on' ELSE 'off' END END AS s, CASE WHEN k % 4 = 2 THEN k > 5 END AS d, k = 3 AS r FROM tk)"


def _tiers(spark, sf):
    r = fx.supplied(spark, sf)
    k = F.col("rec_seq") % 12
    ages = r.filter(k % 4 == 0).select("scanner", (k * 8.0).alias("age"))
    status = r.filter(k % 4 == 1).select("scanner", F.when(k < 6, "on").otherwise("off").alias("state"), F.lit("connectivity").alias("device_class"))
    devices = r.filter(k % 4 == 2).select("scanner", (k > 5).alias("online"))
    return r, ages, status, devices, r.filter(k == 3).select("scanner")


@query(sql(TIERS, "SELECT scanner, CASE WHEN age IS NOT NULL THEN age <= 30 WHEN s IS NOT NULL THEN s = 'on' WHEN d IS NOT NULL THEN d ELSE r END AS online, CASE WHEN age IS NOT NULL THEN 1 WHEN s IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 ELSE 4 END AS tier FROM tg"))
def st12_receiver_status(spark, sf):
    return dg.receiver_status(*_tiers(spark, sf))


@query(sql(TIERS, "SELECT scanner, CASE WHEN k % 5 = 0 THEN k < 6 WHEN age IS NOT NULL THEN age <= 30 WHEN s IS NOT NULL THEN s = 'on' WHEN d IS NOT NULL THEN d ELSE r END AS online, CASE WHEN k % 5 = 0 THEN 1 WHEN age IS NOT NULL THEN 2 WHEN s IS NOT NULL THEN 3 WHEN d IS NOT NULL THEN 4 ELSE 5 END AS tier FROM tg"))
def st13_card_status(spark, sf):
    r, *rest = _tiers(spark, sf)
    k = F.col("rec_seq") % 12
    o = r.filter(k % 5 == 0).select("scanner", F.when(k < 6, "on").otherwise("off").alias("state"))
    return dg.receiver_status(r, *rest, override=o)


@query(sql(NOW, "SELECT scanner FROM pl WHERE scanner NOT IN (SELECT scanner FROM sx) OR scanner IN ('rx2', 'rx9')"))
def st14_offline_panel(spark, sf):
    down = fx.receivers(spark).filter("scanner in ('rx2', 'rx9')")
    return dg.offline_in_panel(_placed(spark), _sensors(spark, sf).select("scanner").distinct(), down)


@query(sql("rg AS (SELECT 'sensor.dev' || user_id || '_distance_to_rx' || r AS entity_id, user_id, r, CASE WHEN r < user_id % 3 THEN 'other' ELSE 'bermuda' END AS platform, user_id * 100 + r AS entity_seq, CASE WHEN r % 2 = 0 THEN user_id * 10 + r // 4 END AS device_id FROM (SELECT DISTINCT user_id FROM events), range(12) AS t(r)), f AS (SELECT user_id, arg_min(device_id, entity_seq) AS device_id FROM rg WHERE platform = 'bermuda' AND device_id IS NOT NULL GROUP BY 1)", "SELECT 'dev' || user_id AS device, CASE WHEN device_id % 2 = 0 THEN 'b' || device_id ELSE 'o' || device_id END AS identifier FROM f"))
def j20_via_device(spark, sf):
    u = fx.table(spark, sf, "events").select("user_id").distinct()
    r = F.broadcast(spark.range(12).select(F.col("id").alias("r")))
    rows = u.join(r, how="cross")
    reg = rows.select(F.concat(F.lit("sensor.dev"), "user_id", F.lit("_distance_to_rx"), "r").alias("entity_id"), F.when(F.col("r") < F.col("user_id") % 3, "other").otherwise("bermuda").alias("platform"), (F.col("user_id") * 100 + F.col("r")).alias("entity_seq"), F.when(F.col("r") % 2 == 0, F.col("user_id") * 10 + F.expr("r div 4")).alias("device_id"))
    ids = reg.select("device_id").filter("device_id is not null").distinct()
    other = F.struct(F.lit("other").alias("domain"), F.concat(F.lit("o"), "device_id").alias("id"))
    own = F.struct(F.lit("bermuda").alias("domain"), F.concat(F.lit("b"), "device_id").alias("id"))
    d = ids.select("device_id", F.when(F.col("device_id") % 2 == 0, F.array(other, own)).otherwise(F.array(other)).alias("identifiers"))
    t = u.select(F.concat(F.lit("dev"), "user_id").alias("device"))
    return dg.via_device(t, reg, d)


@query(sql(SUPPLIED + ", rp AS (SELECT scanner, CASE rec_seq % 3 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'no_data' END AS cause FROM rec WHERE rec_seq <> 4), pn AS (SELECT scanner FROM rec WHERE rec_seq <> 7)", "SELECT scanner, cause AS status FROM rp WHERE cause IS NOT NULL AND scanner IN (SELECT scanner FROM pn) UNION ALL SELECT scanner, 'placed_since' FROM pn WHERE scanner NOT IN (SELECT scanner FROM rp)"))
def j21_report_now(spark, sf):
    r = fx.supplied(spark, sf)
    k = F.col("rec_seq")
    report = r.filter(k != 4).select("scanner", F.when(k % 3 == 0, "unmatched").when(k % 3 == 1, "no_data").alias("cause"))
    return dg.report_now(report, r.filter(k != 7))


FLOORS = "fl AS (SELECT CAST(n_nationkey AS INTEGER) AS floor_seq, CASE WHEN n_nationkey % 2 = 0 THEN ' F' ELSE 'f' END || n_regionkey AS floor, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 1e0 END AS scale, 'r' || (n_nationkey % 7) AS r, 'z' || n_nationkey AS z FROM nation)"


@query(sql(FLOORS, "SELECT arg_min(floor, floor_seq) AS floor, arg_min(scale, floor_seq) FILTER (scale IS NOT NULL) AS scale, CAST(count(DISTINCT r) AS INTEGER) AS n_receivers, string_agg(z, ',' ORDER BY floor_seq) AS zones FROM fl GROUP BY lower(trim(floor))"))
def a22_merged_floors(spark, sf):
    n = F.col("n_nationkey")
    floors = fx.table(spark, sf, "nation").select(
        n.cast("int").alias("floor_seq"), F.concat(F.when(n % 2 == 0, " F").otherwise("f"), "n_regionkey").alias("floor"), F.when(n % 3 == 0, n * 1.0).alias("scale"),
        F.array(F.concat(F.lit("r"), n % 7)).alias("receivers"), F.array(F.concat(F.lit("z"), n)).alias("zones"),
    )
    m = dg.merge_floors(floors)
    return m.select("floor", "scale", F.size("receivers").alias("n_receivers"), F.array_join("zones", ",").alias("zones"))


# Links.
MATRIX = SUPPLIED + ", mx AS (SELECT a.floor, a.scanner AS tx, b.scanner AS rx, a.rec_seq AS i, b.rec_seq AS j, sqrt(((a.x - b.x) / 40e0) * ((a.x - b.x) / 40e0) + ((a.y - b.y) / 40e0) * ((a.y - b.y) / 40e0) + coalesce(a.height - b.height, 0e0) * coalesce(a.height - b.height, 0e0)) AS t FROM rec a JOIN rec b ON a.floor = b.floor AND a.scanner <> b.scanner), mm AS (SELECT *, t * (1 + ((i + j) % 3 - 1) * 0.015e0) AS true_m, t * (1 + ((i * 7 + j * 11) % 13 - 6) / 10e0) AS corrected_m FROM mx), lk AS (SELECT floor, least(tx, rx) AS a, greatest(tx, rx) AS b, min(t) AS live_m, arg_min(true_m, tx) AS true_m, avg(corrected_m) AS detected, arg_max(greatest(-1e0, least(1e0, corrected_m / true_m - 1)), struct_pack(p := abs(greatest(-1e0, least(1e0, corrected_m / true_m - 1))), q := CASE WHEN tx < rx THEN 1 ELSE 0 END)) AS worst FROM mm GROUP BY 1, 2, 3), hu AS (SELECT *, abs(live_m - true_m) > greatest(0.1e0, 0.02e0 * true_m) AS stale, 240 - (worst + 1) * 120 AS hue FROM lk)"


def _links(spark, sf):
    r = fx.supplied(spark, sf)
    a = r.select("floor", F.col("scanner").alias("tx"), F.col("rec_seq").alias("i"))
    from ..operators.calibration import true_distances

    t = true_distances(r).join(a.drop("floor"), "tx").join(r.select(F.col("scanner").alias("rx"), F.col("rec_seq").alias("j")), "rx")
    true_m = F.col("true_m") * (1 + ((F.col("i") + F.col("j")) % 3 - 1) * 0.015)
    corrected = F.col("true_m") * (1 + ((F.col("i") * 7 + F.col("j") * 11) % 13 - 6) / 10.0)
    m = t.select("floor", "tx", "rx", true_m.alias("true_m"), corrected.alias("corrected_m"), corrected.alias("measured_m"))
    return lk.receiver_links(m, r)


@query(sql(MATRIX, "SELECT floor, a, b, round(detected, 5) AS detected, round(worst, 5) AS worst, stale, round(hue, 3) AS hue, CASE WHEN stale THEN 'stale' WHEN hue < 90 THEN 'red' WHEN hue > 150 THEN 'blue' ELSE 'green' END AS band FROM hu"))
def a17_links(spark, sf):
    return _links(spark, sf).select("floor", "a", "b", F.round("detected", 5).alias("detected"), F.round("worst", 5).alias("worst"), "stale", F.round("hue", 3).alias("hue"), "band")


@query(sql(MATRIX, "SELECT floor, a, b, count(*) AS directions FROM (SELECT floor, least(tx, rx) AS a, greatest(tx, rx) AS b FROM mm) GROUP BY 1, 2, 3"))
def j19_undirected_links(spark, sf):
    from ..operators.calibration import true_distances

    t = true_distances(fx.supplied(spark, sf))
    return t.groupBy("floor", F.least("tx", "rx").alias("a"), F.greatest("tx", "rx").alias("b")).agg(F.count(F.lit(1)).alias("directions"))


@query(sql(MATRIX + ", e AS (SELECT floor, a, b, live_m, a AS e FROM lk UNION ALL SELECT floor, a, b, live_m, b FROM lk), k AS (SELECT *, row_number() OVER (PARTITION BY floor, e ORDER BY round(live_m, 9), a, b) AS k FROM e)", "SELECT DISTINCT floor, a, b FROM k WHERE k <= 1"))
def w8_nearest_links(spark, sf):
    return lk.nearest_links(_links(spark, sf).withColumn("live_m", F.round("live_m", 9)), 1).select("floor", "a", "b")


@query(sql(SUPPLIED, "SELECT floor, scanner, CAST(row_number() OVER (PARTITION BY floor ORDER BY rec_seq) - 1 AS INTEGER) AS i FROM rec"))
def w9_sibling_index(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("floor").orderBy("rec_seq")
    return fx.supplied(spark, sf).select("floor", "scanner", (F.row_number().over(w) - 1).alias("i"))


@query(sql("s AS (SELECT 'f' || n_nationkey AS floor, CASE n_nationkey % 4 WHEN 1 THEN 0e0 WHEN 2 THEN NULL WHEN 3 THEN -40e0 ELSE 40e0 + n_nationkey END AS scale FROM nation)", "SELECT floor, scale FROM s WHERE scale > 0"))
def s10_scales(spark, sf):
    from ..operators.evaluation import usable_scales

    n = F.col("n_nationkey")
    rows = fx.table(spark, sf, "nation").select(F.concat(F.lit("f"), n).alias("floor"), F.when(n % 4 == 1, 0.0).when(n % 4 == 3, -40.0).when(n % 4 == 0, 40.0 + n).alias("scale"))
    return usable_scales(rows)


@query(sql("v AS (SELECT p_partkey AS k, CAST(p_partkey % 50 AS DOUBLE) AS a, CAST((p_partkey * 7) % 60 + 60 AS DOUBLE) AS b, CAST((p_partkey * 11) % 70 + 10 AS DOUBLE) AS c FROM part)", "SELECT k, (a + b + b + a) / 4 AS cx, round((c + c + 2 * c + 2 * c) / 4, 6) AS cy, round((b - a) * c, 6) AS area FROM v"))
def a21_vertex_centroid(spark, sf):
    k = F.col("p_partkey")
    a, b, c = (k % 50).cast("double"), ((k * 7) % 60 + 60).cast("double"), ((k * 11) % 70 + 10).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = fx.table(spark, sf, "part").select(k.alias("k"), F.array(point(a, c), point(b, c), point(b, 2 * c), point(a, 2 * c)).alias("ring"))
    m = g.centroid_of_vertices(F.col("ring"))
    return p.select("k", m["x"].alias("cx"), F.round(m["y"], 6).alias("cy"), F.round(g.area(F.col("ring")), 6).alias("area"))
