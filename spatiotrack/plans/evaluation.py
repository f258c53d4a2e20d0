"""Queries of the offline metrics, of publishing and of traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import evaluation as ev
from ..operators import folds, publishing
from ..sources import fixtures as fx
from .common import RECORDING, TRUTH, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _rec(spark, sf):
    return fx.recording(spark, sf).withColumn("seq", F.col("event_id"))


LAG = RECORDING + ", lg AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(floor) OVER w AS pf, lag(zone) OVER w AS pz, row_number() OVER w AS n FROM rc WINDOW w AS (PARTITION BY ent ORDER BY updated, event_id)), stp AS (SELECT ent, event_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step FROM lg WHERE n > 1 AND floor = pf)"


@query(sql(LAG, "SELECT ent, event_id, round(step, 6) AS step FROM stp"))
def w3_steps(spark, sf):
    return ev.steps(_rec(spark, sf)).select("ent", F.col("seq").alias("event_id"), F.round("step", 6).alias("step"))


@query(sql(LAG, "SELECT ent, round(quantile_cont(step / 40, 0.5), 6) AS step_median, round(quantile_cont(step / 40, 0.95), 6) AS step_p95, round(max(step / 40), 6) AS step_max FROM stp GROUP BY 1"))
def a6_step_metrics(spark, sf):
    m = ev.step_metrics(_rec(spark, sf), F.lit(40.0))
    return m.select("ent", *[F.round(c, 6).alias(c) for c in ("step_median", "step_p95", "step_max")])


@query(sql(RECORDING, "SELECT zone, round(quantile_cont(rms_m, 0.25), 6) AS p25, round(quantile_cont(rms_m, 0.5), 6) AS p50, round(quantile_cont(rms_m, 0.95), 6) AS p95 FROM rc GROUP BY 1"))
def a3_percentiles(spark, sf):
    p = lambda q: F.round(F.percentile("rms_m", F.lit(q)), 6)
    return _rec(spark, sf).groupBy("zone").agg(p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.95).alias("p95"))


CEP = RECORDING + ", c AS (SELECT *, avg(x) OVER (PARTITION BY ent) AS cx, avg(y) OVER (PARTITION BY ent) AS cy FROM rc)"


@query(sql(CEP, "SELECT ent, count(*) AS n, round(quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 40, 0.5), 5) AS cep50, round(quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 40, 0.95), 5) AS cep95 FROM c GROUP BY 1"))
def a4_cep(spark, sf):
    return ev.spread_metrics(_rec(spark, sf), F.lit(40.0)).select("ent", "n", F.round("cep50", 5).alias("cep50"), F.round("cep95", 5).alias("cep95"))


@query(sql(RECORDING, "SELECT ent, round(avg(x), 2) AS cx, round(avg(y), 2) AS cy, round(sqrt((avg(x) - 1000) * (avg(x) - 1000) + (avg(y) - 700) * (avg(y) - 700)) / 40, 5) AS bias FROM rc GROUP BY 1"))
def a5_bias(spark, sf):
    m = ev.spread_metrics(_rec(spark, sf), F.lit(40.0), (1000.0, 700.0))
    return m.select("ent", F.round("cx", 2).alias("cx"), F.round("cy", 2).alias("cy"), F.round("bias", 5).alias("bias"))


WAY = [(200.0, 200.0), (1800.0, 200.0), (1800.0, 1200.0)]
_D1 = "sqrt(pow(x - greatest(200e0, least(1800e0, x)), 2) + pow(y - 200, 2))"
_D2 = "sqrt(pow(x - 1800, 2) + pow(y - greatest(200e0, least(1200e0, y)), 2))"


@query(sql(RECORDING + f", d AS (SELECT ent, least({_D1}, {_D2}) / 40 AS d FROM rc)", "SELECT ent, round(sqrt(avg(d * d)), 5) AS crosstrack_rms, round(quantile_cont(d, 0.95), 5) AS crosstrack_p95 FROM d GROUP BY 1"))
def a7_crosstrack(spark, sf):
    m = ev.crosstrack_metrics(_rec(spark, sf), WAY, F.lit(40.0))
    return m.select("ent", F.round("crosstrack_rms", 5).alias("crosstrack_rms"), F.round("crosstrack_p95", 5).alias("crosstrack_p95"))


@query(sql(LAG, "SELECT ent, count(*) AS n, round(max(updated) - min(updated), 1) AS duration_s, CAST(sum(CASE WHEN n > 1 AND floor IS DISTINCT FROM pf THEN 1 ELSE 0 END) AS BIGINT) AS floor_flaps, CAST(sum(CASE WHEN n > 1 AND zone IS DISTINCT FROM pz THEN 1 ELSE 0 END) AS BIGINT) AS zone_flaps FROM lg GROUP BY 1"))
def a8_flaps(spark, sf):
    return ev.flaps(_rec(spark, sf)).select("ent", "n", "duration_s", "floor_flaps", "zone_flaps")


@query(sql(RECORDING + ", c AS (SELECT ent, floor, count(*) AS n, min(struct_pack(a := updated, b := event_id)) AS f FROM rc GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY n DESC, f) AS k FROM c)", "SELECT ent, floor AS main_floor FROM k WHERE k = 1"))
def a9_main_floor(spark, sf):
    return ev.main_floor(_rec(spark, sf))


@query(sql(RECORDING, "SELECT ent, round(avg(CASE WHEN event_id % 10 <> 0 THEN rms_m END), 4) AS rms_m_mean, round(avg(conf), 4) AS conf_mean FROM rc GROUP BY 1"))
def a10_means(spark, sf):
    r = _rec(spark, sf).withColumn("rms_m", F.when(F.col("event_id") % 10 != 0, F.col("rms_m")))
    return r.groupBy("ent").agg(F.round(F.avg("rms_m"), 4).alias("rms_m_mean"), F.round(F.avg("conf"), 4).alias("conf_mean"))


def _series(name: str, x: str, y: str) -> str:
    """Metres of one series of a recording, all metrics of ``score``; every floor of the fixture has 40 pixels a metre."""
    d1, d2 = _D1.replace("x", "@").replace("ma@", "max").replace("y", y).replace("@", x), _D2.replace("x", "@").replace("y", y).replace("@", x)
    return f"""
{name}_c AS (SELECT *, {x} / 40e0 AS mx, {y} / 40e0 AS my, least({d1}, {d2}) / 40 AS ct FROM rc),
{name}_g AS (SELECT *, avg(mx) OVER (PARTITION BY ent) AS cx, avg(my) OVER (PARTITION BY ent) AS cy, lag(mx) OVER w AS px, lag(my) OVER w AS py, lag(floor) OVER w AS pf, row_number() OVER w AS k FROM {name}_c WINDOW w AS (PARTITION BY ent ORDER BY updated, event_id)),
{name}_h AS (SELECT *, sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) AS radial, CASE WHEN k > 1 AND floor = pf THEN sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) END AS step FROM {name}_g),
{name} AS (SELECT ent, '{name}' AS series, any_value(cx) AS cx, any_value(cy) AS cy, quantile_cont(radial, 0.5) AS cep50, quantile_cont(radial, 0.95) AS cep95, quantile_cont(step, 0.5) AS step_median, quantile_cont(step, 0.95) AS step_p95, max(step) AS step_max,
  sqrt((any_value(cx) - 25) * (any_value(cx) - 25) + (any_value(cy) - 17.5e0) * (any_value(cy) - 17.5e0)) AS bias, sqrt(avg(ct * ct)) AS crosstrack_rms, quantile_cont(ct, 0.95) AS crosstrack_p95 FROM {name}_h GROUP BY 1)"""


_SCORED = ("cx", "cy", "cep50", "cep95", "step_median", "step_p95", "step_max", "bias", "crosstrack_rms", "crosstrack_p95")
SCORE = LAG + f""",
hd AS (SELECT ent, count(*) AS n, round(max(updated) - min(updated), 1) AS duration_s, CAST(sum(CASE WHEN n > 1 AND floor IS DISTINCT FROM pf THEN 1 ELSE 0 END) AS BIGINT) AS floor_flaps, CAST(sum(CASE WHEN n > 1 AND zone IS DISTINCT FROM pz THEN 1 ELSE 0 END) AS BIGINT) AS zone_flaps, round(avg(rms_m), 3) AS rms_m_mean, round(avg(conf), 3) AS conf_mean FROM lg GROUP BY 1),
fc AS (SELECT ent, floor, count(*) AS n, min(struct_pack(a := updated, b := event_id)) AS f FROM rc GROUP BY 1, 2),
mf AS (SELECT ent, floor AS main_floor FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY n DESC, f) AS k FROM fc) WHERE k = 1),{_series("published", "x", "y")},{_series("raw", "raw_x", "raw_y")}"""


@query(sql(SCORE, "SELECT ent, n, duration_s, floor_flaps, zone_flaps, rms_m_mean, conf_mean, main_floor, 40e0 AS px_per_m, " + ", ".join(f"round({c} + 1e-7, 5) AS {c}" for c in _SCORED) + ", series, 'm' AS units FROM hd JOIN mf USING (ent) JOIN (SELECT * FROM published UNION ALL SELECT * FROM raw) USING (ent)"))
def score_recording(spark, sf):
    scales = fx.receivers(spark).select("floor", "scale").distinct()
    # All steps are by tracker, so this one shuffle, over as many tasks as there are events for, serves them.
    out = ev.score(_rec(spark, sf).repartition(fx.tasks(spark, sf), "ent"), scales, (1000.0, 700.0), WAY)
    # Many of these are exact halves of the last place; a shift puts them on one side here and in SQL.
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 5) for c in _SCORED})


@query(sql(RECORDING + ", b AS (SELECT ent, avg(sqrt((x - true_x) * (x - true_x) + (y - true_y) * (y - true_y))) AS v, avg(sqrt((raw_x - true_x) * (raw_x - true_x) + (raw_y - true_y) * (raw_y - true_y))) AS w FROM rc GROUP BY 1)", "SELECT ent, round(v - w, 5) AS delta, CASE WHEN v < w THEN 'improved' WHEN v > w THEN 'worse' ELSE 'same' END AS verdict FROM b"))
def compare_baseline(spark, sf):
    def mean(x, y):
        d = F.sqrt(F.pow(F.col(x) - F.col("true_x"), 2) + F.pow(F.col(y) - F.col("true_y"), 2))
        return _rec(spark, sf).groupBy("ent").agg(F.avg(d).alias("bias")).withColumn("series", F.lit("published"))

    return ev.compare(mean("x", "y"), mean("raw_x", "raw_y")).select("ent", F.round("delta", 5).alias("delta"), "verdict")


@query(sql(RECORDING, "SELECT ent, arg_max(event_id, struct_pack(a := updated, b := event_id)) AS event_id, max(updated) AS updated, arg_max(x, struct_pack(a := updated, b := event_id)) AS x, arg_max(zone, struct_pack(a := updated, b := event_id)) AS zone FROM rc GROUP BY 1"))
def k1_latest_fix(spark, sf):
    r = _rec(spark, sf).withColumn("id", F.col("event_id"))
    return publishing.latest_fixes(r.select("ent", "updated", "event_id", "id", "x", "zone")).select("ent", F.col("id").alias("event_id"), "updated", "x", "zone")


KNOWN = RECORDING + ", lf AS (SELECT ent, arg_max(zone, tick) AS zone, arg_max(floor, tick) AS floor FROM rc GROUP BY 1), ss AS (SELECT 'sensor.' || ent || '_bps_zone' AS entity_id, zone AS state FROM lf UNION ALL SELECT 'sensor.' || ent || '_bps_floor', floor FROM lf UNION ALL SELECT 'sensor.' || ent || '_bps_nearest_zone', zone FROM lf UNION ALL SELECT 'sensor.' || ent || '_bps_sub_zone', 'unknown' FROM lf), dv AS (SELECT ent, CAST(substr(ent, 4) AS BIGINT) AS k FROM lf), kn AS (SELECT 'sensor.' || ent || '_' || s AS entity_id FROM dv, (VALUES ('bps_zone'), ('bps_floor'), ('bps_nearest_zone'), ('bps_sub_zone')) AS t(s) WHERE k % 3 <> 0)"


def _latest(spark, sf):
    r = _rec(spark, sf).withColumn("id", F.col("event_id")).select("ent", "updated", "event_id", "zone", "floor")
    latest = publishing.latest_fixes(r)
    return latest.select("ent", "updated", "zone", "floor", F.col("zone").alias("nearest_zone"), F.lit("unknown").alias("sub_zone"), F.col("zone").alias("parent_zone"))


def _devices(spark, sf):
    return _rec(spark, sf).select(F.col("ent").alias("device")).distinct()


def _known(spark, sf):
    d = _devices(spark, sf).filter(F.substring("device", 4, 20).cast("long") % 3 != 0)
    return publishing.expected_sensors(d)


@query(sql(KNOWN, "SELECT entity_id, state FROM ss WHERE entity_id IN (SELECT entity_id FROM kn)"))
def k2_publish_states(spark, sf):
    return publishing.publish_known(publishing.sensor_states(_latest(spark, sf)), _known(spark, sf)).select("entity_id", "state")


@query(sql(KNOWN, "SELECT entity_id FROM ss WHERE entity_id NOT IN (SELECT entity_id FROM kn)"))
def k3_missing_sensors(spark, sf):
    return publishing.missing_sensors(_devices(spark, sf), _known(spark, sf))


@query(sql(KNOWN + ", ex AS (SELECT entity_id FROM ss WHERE NOT contains(entity_id, 'dev1'))", "SELECT entity_id FROM kn WHERE entity_id NOT IN (SELECT entity_id FROM ex)"))
def k4_stale_sensors(spark, sf):
    accuracy = spark.range(1).select(F.lit(publishing.ACCURACY_ID).alias("entity_id"))
    return publishing.stale_sensors(_known(spark, sf).unionByName(accuracy), _devices(spark, sf).filter(~F.col("device").contains("dev1")))


DUP = RECORDING + ", dd AS (SELECT ent, event_id, tick, tick // 2 AS stamp FROM rc), pp AS (SELECT *, lag(stamp) OVER (PARTITION BY ent ORDER BY tick) AS p FROM dd)"


@query(sql(DUP, "SELECT ent, event_id, CAST(stamp AS BIGINT) AS updated FROM pp WHERE p IS NULL OR p <> stamp"))
def k7_new_samples(spark, sf):
    r = _rec(spark, sf).select("ent", "event_id", F.col("tick").alias("seq"), F.expr("tick div 2").alias("updated"))
    return ev.new_samples(r).select("ent", "event_id", "updated")


@query(sql("v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '12.5' ELSE CAST(event_id AS VARCHAR) END AS u FROM events)", "SELECT event_id, coalesce(try_cast(u AS DOUBLE), 0e0) AS updated FROM v"))
def p34_updated(spark, sf):
    e = F.col("event_id")
    u = F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, "soon").when(e % 5 == 2, "12.5").otherwise(e.cast("string"))
    return fx.table(spark, sf, "events").select("event_id", f.updated_or_zero(u).alias("updated"))


@query(sql(DUP.replace("tick // 2", "(tick * 7919) % 31"), "SELECT ent, event_id, row_number() OVER (PARTITION BY ent ORDER BY stamp, tick) AS place FROM pp"))
def l3_sorted_samples(spark, sf):
    r = _rec(spark, sf).withColumn("stamp", (F.col("tick") * 7919) % 31)
    w = Window.partitionBy("ent").orderBy(f.updated_or_zero(F.col("stamp")), "tick")
    return r.select("ent", "event_id", F.row_number().over(w).cast("long").alias("place"))


TRACE = TRUTH + ", tp AS (SELECT 'dev' || device AS ent, tick, CAST(true_x AS DOUBLE) / 40 AS x, CAST(true_y AS DOUBLE) / 40 AS y, 'f' || ((true_floor + tick // 11) % 3) AS floor FROM tr)"


@query(sql(TRACE + ", k AS (SELECT ent, tick, x, y, floor, x AS kx, y AS ky, floor AS kf, true AS kept FROM tp WHERE tick = 1 UNION ALL SELECT p.ent, p.tick, p.x, p.y, p.floor, CASE WHEN far THEN p.x ELSE p.kx END, CASE WHEN far THEN p.y ELSE p.ky END, CASE WHEN far THEN p.floor ELSE p.kf END, far FROM (SELECT tp.*, k.kx, k.ky, k.kf, tp.floor <> k.kf OR (tp.x - k.kx) * (tp.x - k.kx) + (tp.y - k.ky) * (tp.y - k.ky) >= 1 AS far FROM k JOIN tp ON tp.ent = k.ent AND tp.tick = k.tick + 1) p)", "SELECT ent, tick AS seq, round(x, 6) AS x, round(y, 6) AS y FROM k WHERE kept", recursive=True))
def w4_trace(spark, sf):
    return folds.trace(_trace_points(spark, sf)).select("ent", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _trace_points(spark, sf):
    t = fx.truth(spark, sf)
    return t.select(F.concat(F.lit("dev"), "device").alias("ent"), F.col("tick").alias("seq"), (F.col("true_x") / 40.0).alias("x"), (F.col("true_y") / 40.0).alias("y"), F.concat(F.lit("f"), (F.col("true_floor") + F.expr("tick div 11")) % 3).alias("floor"))


@query(sql(TRACE + ", l AS (SELECT *, lag(floor) OVER (PARTITION BY ent ORDER BY tick) AS pf, lag(x) OVER (PARTITION BY ent ORDER BY tick) AS ax, count(*) OVER (PARTITION BY ent) AS al FROM tp)", "SELECT ent, tick AS seq, round(ax, 6) AS ax, CAST(least(7, floor((tick - 2)::DOUBLE / greatest(al - 1, 1) * 8)) AS INTEGER) AS bucket FROM l WHERE floor = 'f1' AND pf = 'f1'"))
def w5_trace_segments(spark, sf):
    return ev.trace_segments(_trace_points(spark, sf), " F1").select("ent", "seq", F.round("ax", 6).alias("ax"), "bucket")


@query(sql(RECORDING + ", lf AS (SELECT ent, max(updated) AS updated FROM rc GROUP BY 1)", "SELECT ent, updated FROM lf WHERE 400 - updated > 300"))
def st8_stale_trackers(spark, sf):
    latest = _rec(spark, sf).groupBy("ent").agg(F.max("updated").alias("updated"))
    return publishing.stale_trackers(latest, F.lit(400.0))


@query(sql(RECORDING + ", v AS (SELECT ent, event_id, updated * 10 + (event_id % 9) * 60 * (tick % 2) * tick AS t FROM rc), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY ent ORDER BY t, event_id) > 300 THEN 1 ELSE 0 END AS c FROM v), s AS (SELECT *, sum(c) OVER (PARTITION BY ent ORDER BY t, event_id) AS visit FROM g)", "SELECT ent, CAST(visit AS BIGINT) AS visit, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM s GROUP BY 1, 2"))
def st8_visits(spark, sf):
    t = F.col("updated") * 10 + (F.col("event_id") % 9) * 60 * (F.col("tick") % 2) * F.col("tick")
    return publishing.visits(_rec(spark, sf).select("ent", "event_id", t.alias("updated")))


@query(sql(RECORDING, "SELECT 'sensor.' || ent || '_bps_nearest_zone' AS entity_id, 'unknown' AS state FROM (SELECT ent FROM rc GROUP BY 1 HAVING max(CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END) = 0)"))
def st9_out_of_range(spark, sf):
    c = _rec(spark, sf).filter("event_id % 31 = 0").select(F.col("ent").alias("device"))
    return publishing.out_of_range(_devices(spark, sf), c)


@query(sql(RECORDING, "SELECT event_id, ent, CASE WHEN event_id % 13 = 0 THEN false ELSE floor <> 'f1' END AS off_floor FROM rc WHERE CAST(substr(ent, 4) AS BIGINT) % 5 = 0"))
def st21_followed(spark, sf):
    r = _rec(spark, sf).withColumn("floor", F.when(F.col("event_id") % 13 != 0, F.col("floor")))
    tracked = r.select("ent").distinct().filter(F.substring("ent", 4, 20).cast("long") % 5 == 0)
    return publishing.followed(r, tracked, "f1").select("event_id", "ent", "off_floor")


@query(sql(RECORDING + ", lf AS (SELECT ent, arg_max(floor, tick) AS floor FROM rc GROUP BY 1)", "SELECT c AS card_floor, count(*) FILTER (floor = c) AS shown, count(*) AS total FROM lf, (VALUES ('f0'), ('f1'), ('f2')) AS t(c) GROUP BY 1"))
def st22_on_floor(spark, sf):
    r = _rec(spark, sf)
    last = r.groupBy("ent").agg(F.max_by("floor", "tick").alias("floor"))
    cards = F.explode(F.array(*[F.lit(f"f{k}") for k in range(3)])).alias("card_floor")
    return publishing.on_floor_counts(r, last.select("ent", "floor", cards))


@query(sql(RECORDING + ", lf AS (SELECT ent, max(updated) AS updated FROM rc GROUP BY 1), g AS (SELECT ent FROM lf WHERE 400 - updated > 300)", "SELECT 'sensor.' || ent || '_' || s AS entity_id, 'unknown' AS state, CASE WHEN s = 'bps_sub_zone' THEN 'unknown' END AS parent_zone FROM g, (VALUES ('bps_zone'), ('bps_floor'), ('bps_nearest_zone'), ('bps_sub_zone')) AS t(s)"))
def d15_cleared_states(spark, sf):
    return publishing.cleared_states(st8_stale_trackers(spark, sf))
