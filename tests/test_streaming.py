from aerolith.streaming.weather import hourly, write_hours


def test_hours(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, f"2023-03-01 {h:02d}:{m:02d}:00", float(h)) for h in range(12) for m in (0, 30)] + [(1, "2023-03-01 03:00:00", 3.0), (1, "2023-03-01 04:00:00", None)]
    spark.createDataFrame(rows, "station_id bigint, s string, T double").selectExpr("station_id", "CAST(s AS TIMESTAMP) AS at", "T").write.parquet(src)
    stream = spark.readStream.schema("station_id bigint, at timestamp, T double").parquet(src)
    write_hours(hourly(stream, "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.hour.hour: (r.mean, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[3] == (3.0, 2) and all(v == (float(h), 2) for h, v in got.items()) and 11 not in got
