import pytest

from aerolith.functions.timekeys import hour_label, minutes_of_key, read_key


@pytest.mark.parametrize(
    "key, label",
    [
        ("2023030924", "2023031000"), ("202303092400", "2023031000"), ("202303092430", None), ("2023-03-09T15:00+01:00", "2023030914"), ("2023-03-09T15:00-0130", "2023030916"), ("  2023-03-09 15:00:30 ", "2023030915"),
        ("09/03/2023 24:00", "2023031000"), ("abc", None), ("", None), ("2023023107", None), ("20230228", None), ("2024-02-29T01:00Z", "2024022901"), ("2023-13-01T00:00Z", None), (None, None),
    ],
)
def test_keys(spark, key, label):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([(key,)], "k string").select(minutes_of_key(F.col("k")).alias("m"))
    assert m.select(hour_label(F.col("m"))).first()[0] == label
    if key is not None:
        assert m.first()[0] == read_key(key)
