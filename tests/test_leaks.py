"""Rows dated after a moment never change its features."""

from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.sources import testdata as src


def test_later_rows_change_nothing(spark, tiny):
    cells = src.families(spark, tiny).select("family_id", F.col("collab_flag").alias("label"), F.lit("1997-06-01").cast("date").alias("prediction_moment"))
    args = src.attention(spark, tiny), src.families(spark, tiny), src.celebrity_events(spark, tiny)
    sales = src.sales(spark, tiny)
    spoiled = sales.withColumn("sold_price_usd", F.when(F.col("sold_date") > "1997-06-01", F.col("sold_price_usd") * 100).otherwise(F.col("sold_price_usd")))
    rows = lambda s: sorted(map(str, features.features(cells, s, *args).collect()))
    assert rows(sales) == rows(spoiled)
