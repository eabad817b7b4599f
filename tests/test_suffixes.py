import pytest
from pyspark.sql import functions as F

from webquarry.functions import suffixes


@pytest.mark.parametrize(
    ("host", "site"),
    [("www.bbc.co.uk", "bbc.co.uk"), ("alice.github.io", "alice.github.io"), ("a.b.example.com", "example.com"), ("example.com", "example.com"), ("com", ""), ("co.uk", ""), ("", ""), ("127.0.0.1", ""), ("www.ck", "www.ck"), ("a.b.ck", "a.b.ck"), ("x.unknownsuffix", "x.unknownsuffix"), ("Blog.Example.ORG", "example.org")],
)
def test_registrable(spark, host, site):
    assert suffixes.registrable(host, suffixes.rules(spark)) == site


def test_column(spark):
    df = spark.createDataFrame([("a.example.com",), (None,), ("x.github.io",)], "h string")
    assert [r[0] for r in df.select(suffixes.site(spark, "h")).collect()] == ["example.com", "", "x.github.io"]
    assert df.select(suffixes.site(spark, F.col("h"))).count() == 3
