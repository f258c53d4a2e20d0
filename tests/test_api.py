import json

import pytest
from pyspark.sql import functions as F

from spatiotrack import api
from spatiotrack.sources import fixtures as fx


def test_functions_from_sql(spark):
    api.register(spark)
    p = "named_struct('x', {}D, 'y', {}D, 'r', {}D)"
    points = ", ".join(p.format(x, y, 50**0.5) for x, y in ((0, 0), (10, 0), (0, 10)))
    r = spark.sql(f"SELECT trilaterate(array({points}), 0.001D) AS f").first().f
    assert (r.x, r.y) == pytest.approx((5, 5), abs=0.05)
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 1D))"
    assert spark.sql(f"SELECT * FROM polygon_edges({ring})").count() == 3
    doc = json.dumps({"floor": [{"name": "f", "receivers": [{"entity_id": "a", "cords": {"x": 1, "y": 2}}, {"entity_id": ""}]}]})
    rows = spark.sql(f"SELECT * FROM layout_receivers('{doc}')").collect()
    assert [r.scanner for r in rows] == ["a"]


def test_calibration_improves_the_selftest(spark, sf):
    from spatiotrack.operators import calibration as cal

    samples, flat = fx.calibration_samples(spark, sf), fx.receivers(spark).withColumn("correction", F.lit(1.0))
    c = api.Calibration(samples, flat)
    fitted = c.apply().drop("changed")
    assert c.reset().filter("correction is null").count() == 12
    error = lambda r: cal.selftest(samples, r, fx.zones(spark)).agg(F.avg("error_m")).first()[0]
    assert error(fitted.select(flat.columns)) < error(flat)
    mean = c.solve().groupBy("floor").agg(F.avg(F.log10("correction")).alias("m")).collect()
    assert all(abs(r.m) < 1e-3 for r in mean)


def test_distance_labels_round_by_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from spatiotrack.functions import scalars

    values = [k / 100 for k in range(4001)] + [-0.04, -0.25, 0.95, 9.95, 1e17, 123456.75]
    rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", scalars.distance_label(F.col("v")).alias("label")).collect()
    assert {r.v: r.label for r in rows} == {v: f"{Decimal(v).quantize(Decimal('0.1'), ROUND_HALF_UP)} m" for v in values}


def test_every_floor_has_its_scale(spark):
    from spatiotrack.operators import evaluation

    scales = spark.range(100_050, numPartitions=1).select(F.concat(F.lit("f"), "id").alias("floor"), F.lit(40.0).alias("scale"))
    rows = [("a", i, float(i), "f100049", "z", 1.0 * i, 2.0, 1.0 * i, 2.0, 0.5, 0.5) for i in range(5)]
    samples = spark.createDataFrame(rows, "ent string, seq int, updated double, floor string, zone string, x double, y double, raw_x double, raw_y double, rms_m double, conf double")
    assert {r.px_per_m for r in evaluation.score(samples, scales).collect()} == {40.0}
