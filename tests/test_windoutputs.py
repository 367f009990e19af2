from pyspark.sql import functions as F

from aerolith.plans.windfield import QUERIES


def test_outputs_have_speed_and_direction(spark, folder):
    """wind_outputs: the corrected field has a part across the wind."""
    x = QUERIES["wind_outputs"](spark, folder)
    r = x.agg(F.count("*"), F.max(F.abs("u")), F.max(F.abs(F.col("speed") - F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))), F.min("direction"), F.max("direction")).first()
    assert r[0] > 0 and r[1] > 0.05 and r[2] < 1e-5 and 0 <= r[3] <= r[4] <= 360
