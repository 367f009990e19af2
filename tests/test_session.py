from aerolith.session import clear, cut


def test_cut_and_clear(spark):
    df = cut(spark.range(5).selectExpr("id", "TIMESTAMP_NTZ '2023-01-01 00:00:00' AS t"))
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    empty = cut(spark.range(0).selectExpr("id"))
    assert empty.count() == 0
    clear(spark)
