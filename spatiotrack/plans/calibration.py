"""Queries of calibration and self-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import calibration as cal
from ..sources import files
from ..sources import fixtures as fx
from ..streaming import calibration as sc
from .common import EDGES, RECEIVERS, SUPPLIED, solved, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


SAMPLES = RECEIVERS + """,
li AS (SELECT *, CAST(l_suppkey % 12 AS INTEGER) AS t, CAST(l_partkey % 12 AS INTEGER) AS q FROM lineitem),
lj AS (SELECT *, CAST(row_number() OVER (PARTITION BY t, q ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INTEGER) AS seq FROM li WHERE t <> q AND t // 4 = q // 4),
sm AS (SELECT a.scanner AS tx, b.scanner AS rx, seq, a.floor,
  sqrt(((a.x - b.x) / 40e0) * ((a.x - b.x) / 40e0) + ((a.y - b.y) / 40e0) * ((a.y - b.y) / 40e0) + coalesce(a.height - b.height, 0e0) * coalesce(a.height - b.height, 0e0))
  * (1 + 0.05e0 * (q % 4 - 1)) * (1 + ((l_orderkey * 31 + l_linenumber * 17) % 41 - 20) / 1000e0) AS distance_m
  FROM lj JOIN rec a ON a.rec_seq = t JOIN rec b ON b.rec_seq = q),
td AS (SELECT a.floor, a.scanner AS tx, b.scanner AS rx, sqrt(((a.x - b.x) / 40e0) * ((a.x - b.x) / 40e0) + ((a.y - b.y) / 40e0) * ((a.y - b.y) / 40e0) + coalesce(a.height - b.height, 0e0) * coalesce(a.height - b.height, 0e0)) AS true_m FROM rec a JOIN rec b ON a.floor = b.floor AND a.scanner <> b.scanner),
md AS (SELECT tx, rx, quantile_cont(distance_m, 0.5) AS measured_m, count(*) AS samples FROM sm GROUP BY 1, 2),
pr AS (SELECT td.floor, tx, rx, true_m, measured_m, samples FROM md JOIN td USING (tx, rx) WHERE samples >= 5 AND measured_m > 0 AND true_m >= 0.3)"""  # fmt: skip


def _samples(spark, sf):
    return fx.calibration_samples(spark, sf)


def _pairs(spark, sf):
    return cal.usable_pairs(_samples(spark, sf), fx.receivers(spark))


APART = SUPPLIED + ", td AS (SELECT a.floor, a.scanner AS tx, b.scanner AS rx, sqrt(((a.x - b.x) / 40e0) * ((a.x - b.x) / 40e0) + ((a.y - b.y) / 40e0) * ((a.y - b.y) / 40e0) + coalesce(a.height - b.height, 0e0) * coalesce(a.height - b.height, 0e0)) AS true_m FROM rec a JOIN rec b ON a.floor = b.floor AND a.scanner <> b.scanner)"


@query(sql(APART, "SELECT floor, tx, rx, round(true_m, 6) AS true_m FROM td"))
def p7_true_distance(spark, sf):
    return cal.true_distances(fx.supplied(spark, sf)).select("floor", "tx", "rx", F.round("true_m", 6).alias("true_m"))


@query(sql(SAMPLES, "SELECT tx, rx, round(measured_m, 6) AS measured_m, samples FROM md WHERE samples >= 5"))
def a2_pair_median(spark, sf):
    m = _samples(spark, sf).groupBy("tx", "rx").agg(F.percentile("distance_m", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("samples"))
    return m.filter("samples >= 5").select("tx", "rx", F.round("m", 6).alias("measured_m"), "samples")


@query(sql(SAMPLES, "SELECT floor, tx, rx, round(true_m, 6) AS true_m, round(measured_m, 6) AS measured_m, samples FROM pr"))
def j9_usable_pairs(spark, sf):
    return _pairs(spark, sf).select("floor", "tx", "rx", F.round("true_m", 6).alias("true_m"), F.round("measured_m", 6).alias("measured_m"), "samples")


@query(sql(SAMPLES, "SELECT p.floor, p.tx AS a, p.rx AS b, round(p.measured_m, 6) AS ab_m, round(q.measured_m, 6) AS back_m FROM pr p JOIN pr q ON p.tx = q.rx AND p.rx = q.tx AND p.floor = q.floor WHERE p.tx < p.rx"))
def j10_both_ways(spark, sf):
    return cal.both_ways(_pairs(spark, sf)).select("floor", "a", "b", F.round("ab_m", 6).alias("ab_m"), F.round("back_m", 6).alias("back_m"))


@query(sql(SAMPLES, "SELECT floor, tx, rx, round(log10(measured_m / true_m), 6) AS y, round(1 / (1 + true_m), 6) AS weight FROM pr"))
def p26_log_ratio(spark, sf):
    return cal.log_ratios(_pairs(spark, sf)).select("floor", "tx", "rx", F.round("y", 6).alias("y"), F.round("weight", 6).alias("weight"))


@query()
def m3_calibration(spark, sf):
    pairs = _pairs(spark, sf)
    c = cal.corrections(cal.calibrate(pairs), pairs)
    return c.select("floor", "scanner", "correction", "db", "pairs", "low_confidence")


@query(sql(SAMPLES + ", ends AS (SELECT floor, tx AS scanner FROM pr UNION SELECT floor, rx FROM pr), many AS (SELECT floor FROM pr GROUP BY 1 HAVING count(*) >= 4)", "SELECT floor, scanner, true AS rx_settled, true AS tx_settled FROM ends JOIN many USING (floor)"))
def m3_settled(spark, sf):
    """The fit's biases are a minimum: the gradient of the cost, summed over pairs by joins, is zero in each or points out of its bound."""
    pairs = _pairs(spark, sf)
    return cal.settled(cal.calibrate(pairs), pairs)


FACTORS = RECEIVERS + ", fb AS (SELECT floor, scanner, 0.02e0 * ((rec_seq * 7) % 11) - 0.1e0 AS rx_log, 0.01e0 * ((rec_seq * 5) % 7) AS tx_log FROM rec), ft AS (SELECT *, pow(10e0, -rx_log - avg(-rx_log) OVER (PARTITION BY floor)) AS raw FROM fb), fc AS (SELECT *, round(least(5e0, greatest(0.2e0, raw)), 4) AS correction FROM ft)"


def _biases(spark):
    r = fx.receivers(spark)
    k = F.col("rec_seq")
    return r.select("floor", "scanner", (F.lit(0.02) * ((k * 7) % 11) - 0.1).alias("rx_log"), (F.lit(0.01) * ((k * 5) % 7)).alias("tx_log"))


@query(sql(FACTORS, "SELECT floor, scanner, correction FROM fc"))
def a13_normalised_corrections(spark, sf):
    return cal.corrections(_biases(spark), _pairs(spark, sf)).select("floor", "scanner", "correction")


@query(sql(FACTORS, "SELECT scanner, round(-30 * log10(correction), 1) AS db FROM fc"))
def p24_bias_db(spark, sf):
    return cal.corrections(_biases(spark), _pairs(spark, sf)).select("scanner", "db")


@query(sql("v AS (SELECT event_id, (event_id % 997) / 100e0 AS f FROM events)", "SELECT event_id, round(least(5e0, greatest(0.2e0, f)), 4) AS factor FROM v"))
def p23_clamped_factor(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", f.correction_factor((F.col("event_id") % 997) / 100.0).alias("factor"))


@query(sql("v AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 5000 END AS d FROM events)", "SELECT event_id, CAST(least(3600, greatest(60, coalesce(d, 600))) AS BIGINT) AS duration FROM v"))
def p27_duration(spark, sf):
    e = fx.table(spark, sf, "events")
    d = F.when(F.col("event_id") % 17 != 0, F.col("event_id") % 5000)
    return e.select("event_id", F.least(F.lit(3600), F.greatest(F.lit(60), F.coalesce(d, F.lit(600)))).alias("duration"))


@query(sql(SAMPLES + FACTORS[len(RECEIVERS):] + ", pc AS (SELECT scanner, count(*) AS pairs FROM (SELECT tx AS scanner FROM pr UNION ALL SELECT rx FROM pr) GROUP BY 1)", "SELECT fc.floor, fc.scanner, coalesce(pairs, 0) AS pairs, (correction < 0.5 OR correction > 2 OR coalesce(pairs, 0) < 3) AS low_confidence FROM fc LEFT JOIN pc USING (scanner)"))
def a12_low_confidence(spark, sf):
    return cal.corrections(_biases(spark), _pairs(spark, sf)).select("floor", "scanner", "pairs", "low_confidence")


@query(sql(SAMPLES + FACTORS[len(RECEIVERS):], "SELECT pr.floor, tx, rx, round(true_m, 2) AS true_m, round(measured_m * correction, 2) AS corrected_m, round((measured_m / true_m - 1) * 100, 1) AS error_pct, samples FROM pr JOIN fc ON fc.scanner = rx"))
def p25_matrix(spark, sf):
    pairs = _pairs(spark, sf)
    return cal.matrix(pairs, cal.corrections(_biases(spark), pairs)).select("floor", "tx", "rx", "true_m", "corrected_m", "error_pct", "samples")


@query(sql(SAMPLES + FACTORS[len(RECEIVERS):] + ", e AS (SELECT pr.floor, abs(log10(measured_m / true_m)) AS b, abs(log10(measured_m / true_m) - r.rx_log - t.tx_log) AS a FROM pr JOIN fb r ON r.scanner = rx JOIN fb t ON t.scanner = tx)", "SELECT floor, count(*) AS pairs_used, round(pow(10, quantile_cont(b, 0.5)), 3) AS error_factor_before, round(pow(10, quantile_cont(a, 0.5)), 3) AS error_factor_after FROM e GROUP BY 1"))
def a14_error_factors(spark, sf):
    return cal.error_factors(_pairs(spark, sf), _biases(spark))


@query(sql(SAMPLES, "SELECT tx, rx, seq, round(distance_m, 6) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY tx, rx ORDER BY seq DESC) AS n FROM sm) WHERE n <= 720"))
def w6_rolling_window(spark, sf):
    return cal.rolling_window(_samples(spark, sf), 720).select("tx", "rx", "seq", F.round("distance_m", 6).alias("distance_m"))


@query(sql(SAMPLES, "SELECT tx, rx, seq, round(distance_m, 6) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY tx, rx ORDER BY seq DESC) AS n FROM sm) WHERE n <= 40"))
def st16_bounded_window(spark, sf):
    """The window of a job whose samples came in seven batches, compacted every third; what is left is what was read."""
    samples = _samples(spark, sf).select(F.col("seq").cast("double").alias("dump"), "tx", "rx", F.lit(0.0).alias("stamp"), "distance_m")
    window = sc.RollingWindow(files.Parts(spark, files.work_folder(spark, "window")), 40, every=3)
    ends = samples.agg(F.min("dump"), F.max("dump")).first()
    step = ((ends[1] or 0) - (ends[0] or 0) + 1) / 7
    for k in range(7):
        window.add(samples.filter((F.col("dump") >= (ends[0] or 0) + k * step) & (F.col("dump") < (ends[0] or 0) + (k + 1) * step)), k)
    return window.read(6).select("tx", "rx", F.col("dump").cast("int").alias("seq"), F.round("distance_m", 6).alias("distance_m"))


@query(sql(SAMPLES, "SELECT tx, rx, count(*) AS kept, min(seq) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY tx, rx ORDER BY seq DESC) AS n FROM sm) WHERE n <= 200 GROUP BY 1, 2"))
def k6_persisted_samples(spark, sf):
    return cal.rolling_window(_samples(spark, sf), 200).groupBy("tx", "rx").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("oldest"))


@query(sql(SAMPLES, "SELECT tx, rx, count(*) AS n FROM sm WHERE 30000 - seq * 60 <= 21600 GROUP BY 1, 2"))
def s12_restored_samples(spark, sf):
    s = _samples(spark, sf).withColumn("saved_at", F.col("seq") * F.lit(60.0))
    return cal.restore(s, F.lit(30000.0)).groupBy("tx", "rx").agg(F.count(F.lit(1)).alias("n"))


@query(sql(SAMPLES + ", n AS (SELECT tx, rx, CAST(seq // 20 AS BIGINT) AS dump, seq * 2e0 AS stamp, distance_m FROM sm), m AS (SELECT *, max(stamp) OVER (PARTITION BY dump) AS newest FROM n)", "SELECT dump, tx, rx, count(*) AS n, round(sum(distance_m), 5) AS total FROM m WHERE newest - stamp <= 30 AND distance_m > 0 AND tx <> 'rx5' AND rx <> 'rx5' GROUP BY 1, 2, 3"))
def s7_ingest_dump(spark, sf):
    mac = lambda c: F.concat(F.lit("AA:00:"), c)
    s = _samples(spark, sf).select(F.expr("seq div 20").alias("dump"), mac(F.col("tx")).alias("address"), mac(F.col("rx")).alias("scanner_address"), (F.col("seq") * 2.0).alias("stamp"), F.col("distance_m").alias("distance"))
    matches = fx.receivers(spark).filter("scanner <> 'rx5'").select(F.lower(mac(F.col("scanner"))).alias("address"), F.col("scanner").alias("slug"))
    return cal.ingest_dump(s, matches).groupBy("dump", "tx", "rx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance_m"), 5).alias("total"))


@query(sql(SAMPLES, "SELECT floor, scanner, CASE WHEN rec_seq % 3 = 0 AND 100000 - rec_seq * 5000 <= 21600 THEN 'no_data' ELSE 'unmatched' END AS cause FROM rec WHERE scanner NOT IN (SELECT tx FROM pr WHERE floor = 'f1' UNION ALL SELECT rx FROM pr WHERE floor = 'f1')"))
def d13_missing_receivers(spark, sf):
    r = fx.receivers(spark)
    matched = r.filter("rec_seq % 3 = 0").select(F.col("scanner").alias("slug"), (F.col("rec_seq") * 5000.0).alias("matched_at"))
    return cal.missing_receivers(r, _pairs(spark, sf).filter("floor = 'f1'"), matched, F.lit(100000.0))


@query(sql(FACTORS, "SELECT rec.scanner, CASE WHEN rec.floor = 'f1' THEN fc.correction ELSE rec.correction END AS correction, rec.floor = 'f1' AND rec.correction <> fc.correction AS changed FROM rec JOIN fc USING (scanner)"))
def k8_apply_corrections(spark, sf):
    c = cal.corrections(_biases(spark), _pairs(spark, sf))
    return cal.apply_corrections(fx.receivers(spark), c, F.lit(" F1 ")).select("scanner", "correction", "changed")


@query(sql(FACTORS, "SELECT floor, round(max(abs(fc.correction / rec.correction - 1)), 6) AS change FROM fc JOIN rec USING (floor, scanner) GROUP BY 1 HAVING max(abs(fc.correction / rec.correction - 1)) >= 0.01"))
def st16_worth_writing(spark, sf):
    c = cal.corrections(_biases(spark), _pairs(spark, sf))
    return cal.worth_writing(c, fx.receivers(spark)).select("floor", F.round("change", 6).alias("change"))


@query(sql(SAMPLES + ", m AS (SELECT tx, rx, quantile_cont(distance_m, 0.5) AS m FROM sm WHERE distance_m > 0 GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT tx, rx, o.x, o.y, m * o.correction AS d, o.height - t.height AS dz FROM m JOIN rec t ON t.scanner = tx JOIN rec o ON o.scanner = rx AND o.floor_seq = t.floor_seq)", "SELECT tx AS target, rx, x, y, round(40 * CASE WHEN dz IS NULL THEN d ELSE sqrt(greatest(d * d - dz * dz, 0e0)) END, 5) AS r FROM c"))
def j11_selftest_points(spark, sf):
    return cal.selftest_points(_samples(spark, sf), fx.receivers(spark)).select("target", "rx", "x", "y", F.round("r", 5).alias("r"))


SELFTEST = SAMPLES + "," + EDGES + """,
mt AS (SELECT tx, rx, quantile_cont(distance_m, 0.5) AS m FROM sm WHERE distance_m > 0 GROUP BY 1, 2 HAVING count(*) >= 3),
hr AS (SELECT tx, o.rec_seq, o.x, o.y, m * o.correction AS d, o.height - t.height AS dz FROM mt JOIN rec t ON t.scanner = tx JOIN rec o ON o.scanner = rx AND o.floor_seq = t.floor_seq),
hp AS (SELECT tx, rec_seq, x, y, 40 * CASE WHEN dz IS NULL THEN d ELSE sqrt(greatest(d * d - dz * dz, 0e0)) END AS r, 1e0 AS w FROM hr),
ext AS (SELECT floor_seq, min(x) AS ex0, min(y) AS ey0, max(x) AS ex1, max(y) AS ey1 FROM (SELECT floor_seq, x, y FROM rec UNION ALL SELECT floor_seq, ax, ay FROM zed) GROUP BY 1),
eb AS (SELECT floor_seq, ex0 - m AS x0, ey0 - m AS y0, ex1 + m AS x1, ey1 + m AS y1 FROM (SELECT *, 0.1e0 * greatest(ex1 - ex0, ey1 - ey0, 1e0) AS m FROM ext)),
hg AS (SELECT tx AS id, count(*) AS n, avg(x) AS sx, avg(y) AS sy, """ + ", ".join(f"max(CASE WHEN rec_seq % 4 = {i} THEN r END) AS r{i}, max(CASE WHEN rec_seq % 4 = {i} THEN w END) AS w{i}" for i in range(4)) + """ FROM hp GROUP BY 1),
hb AS (SELECT hg.*, x0, y0, x1, y1 FROM hg JOIN rec ON scanner = id JOIN eb USING (floor_seq) WHERE n >= 3),""" + solved("hb")


@query(sql(SELFTEST, "SELECT floor, scanner, CAST(coalesce(hg.n, 0) AS INTEGER) AS heard_by, round(fx, 1) AS est_x, round(fy, 1) AS est_y, round(sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) / 40e0, 3) AS error_m FROM rec LEFT JOIN hg ON hg.id = scanner LEFT JOIN so ON so.id = scanner", recursive=True))
def m4_selftest(spark, sf):
    return cal.selftest(_samples(spark, sf), fx.receivers(spark), fx.zones(spark)).drop("floor_seq")


ERRORS = SUPPLIED + ", er AS (SELECT floor, scanner, rec_seq AS place, CASE WHEN rec_seq % 6 <> 5 THEN ((rec_seq * 37) % 23) / 8e0 END AS error_m FROM rec)"


@query(sql(ERRORS, "SELECT floor, count(*) AS placed, count(error_m) AS solved, round(quantile_cont(error_m, 0.5), 3) AS cep50_m, round(quantile_cont(error_m, 0.95), 3) AS cep95_m, round(avg(error_m), 3) AS mean_m, round(max(error_m), 3) AS max_m, arg_max(scanner, struct_pack(a := coalesce(error_m, -1), b := -place)) AS worst FROM er GROUP BY GROUPING SETS ((floor), ())"))
def a11_selftest_summary(spark, sf):
    k = F.col("rec_seq")
    er = fx.supplied(spark, sf).select("floor", "scanner", k.alias("place"), F.when(k % 6 != 5, ((k * 37) % 23) / 8.0).alias("error_m"))
    return cal.selftest_summary(er)


@query(sql(SAMPLES, "SELECT count(DISTINCT tx || '|' || rx) AS pairs, count(*) AS samples, min(n) AS least, max(n) AS most FROM (SELECT tx, rx, count(*) OVER (PARTITION BY tx, rx) AS n FROM sm)"))
def a16_sample_counts(spark, sf):
    c = _samples(spark, sf).groupBy("tx", "rx").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("samples"), F.min("n").alias("least"), F.max("n").alias("most"))


# Manual runs: each user's events are the calls of one, a third of them failed in stretches.
CALLS = "cl AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS k FROM events), ca AS (SELECT run, k * 10e0 AS moment, NOT ((k // 8 + run) % 3 = 0 AND k % 8 < 5 + run % 3) AS ok FROM cl)"


def _calls(spark, sf):
    t = fx.truth(spark, sf)
    k, run = F.col("tick"), F.col("device")
    return t.select(run.alias("run"), (k * 10.0).alias("at"), (~(((F.floor(k / 8) + run) % 3 == 0) & (k % 8 < 5 + run % 3))).alias("ok"))


@query(sql(CALLS + ", g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run ORDER BY moment) AS good FROM ca), h AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY run, good ORDER BY moment) AS failed FROM g), b AS (SELECT *, min(CASE WHEN failed >= 6 THEN moment END) OVER (PARTITION BY run) AS broken FROM h)", "SELECT run, CASE WHEN max(broken) IS NOT NULL THEN 'error' ELSE 'done' END AS state, max(moment) AS ended_at, count(*) FILTER (ok) AS dumps FROM b WHERE broken IS NULL OR moment <= broken GROUP BY run"))
def st15_manual_runs(spark, sf):
    return sc.manual_runs(_calls(spark, sf))


@query(sql(CALLS + """,
n AS (SELECT run, moment, moment - min(moment) OVER (PARTITION BY run) AS age FROM ca),
s AS (SELECT run, min(moment) AS moment FROM n WHERE age >= 300 GROUP BY run
  UNION ALL SELECT run, moment FROM (SELECT s.run, (SELECT min(n.moment) FROM n WHERE n.run = s.run AND n.moment >= s.moment + 900) AS moment FROM s) WHERE moment IS NOT NULL)""", "SELECT CAST(run AS VARCHAR) AS run, moment FROM s", recursive=True))
def st16_solve_times(spark, sf):
    return sc.solve_times(_calls(spark, sf)).withColumnRenamed("at", "moment")


@query(sql(CALLS + """,
s AS (SELECT run, min(moment) AS moment FROM ca GROUP BY run
  UNION ALL SELECT run, moment FROM (SELECT s.run, (SELECT min(c.moment) FROM ca c WHERE c.run = s.run AND c.moment >= s.moment + 1800) AS moment FROM s) WHERE moment IS NOT NULL)""", "SELECT CAST(run AS VARCHAR) AS run, moment FROM s", recursive=True))
def st18_selftest_times(spark, sf):
    return sc.due_times(_calls(spark, sf), 1800.0).withColumnRenamed("at", "moment")


CHANGE = ERRORS + ", ol AS (SELECT CASE WHEN rec_seq % 5 <> 4 THEN ((rec_seq * 29) % 19) / 8e0 END AS error_m FROM rec), a AS (SELECT round(quantile_cont(error_m, 0.5), 3) AS cep50_m, round(quantile_cont(error_m, 0.95), 3) AS cep95_m, round(avg(error_m), 3) AS mean_m, round(max(error_m), 3) AS max_m FROM er), b AS (SELECT round(quantile_cont(error_m, 0.5), 3) AS cep50_m, round(quantile_cont(error_m, 0.95), 3) AS cep95_m, round(avg(error_m), 3) AS mean_m, round(max(error_m), 3) AS max_m FROM ol), m AS (UNPIVOT a ON cep50_m, cep95_m, mean_m, max_m INTO NAME metric VALUE now_m), n AS (UNPIVOT b ON cep50_m, cep95_m, mean_m, max_m INTO NAME metric VALUE baseline_m)"


@query(sql(CHANGE, "SELECT metric, now_m, baseline_m, round(now_m - baseline_m, 3) AS change_m, CASE WHEN round(now_m - baseline_m, 3) < 0 THEN 'improved' WHEN round(now_m - baseline_m, 3) > 0 THEN 'worse' ELSE 'same' END AS verdict FROM m JOIN n USING (metric)"))
def k10_selftest_change(spark, sf):
    k = F.col("rec_seq")
    r = fx.supplied(spark, sf)
    rows = lambda error: r.select("floor", "scanner", k.alias("place"), error.alias("error_m"))
    new, old = rows(F.when(k % 6 != 5, ((k * 37) % 23) / 8.0)), rows(F.when(k % 5 != 4, ((k * 29) % 19) / 8.0))
    return sc.selftest_change(cal.selftest_summary(new), cal.selftest_summary(old))
