"""Joins on family and month find what a range join over the whole history finds."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions.dates import month_of, months_after, within_before
from tidemark.operators import features


def days(n):
    return [datetime.date(2023, 11, 1) + datetime.timedelta(i) for i in range(n)]


def test_months_reach_every_day_in_the_window(spark):
    moments = spark.createDataFrame([(m,) for m in days(200)], "m date")
    rows = spark.createDataFrame([(x,) for x in [*days(200), None]], "x date")
    for width in (1, 30, 60, 90, 120):
        wide = moments.join(rows, within_before("x", "m", width))
        keyed = moments.withColumn("month", month_of("m")).join(months_after(rows, "x", width), "month").where(within_before("x", "m", width))
        assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, keyed.select("m", "x").collect()))


def test_celebrity_signal_counts_own_and_brand_wide_events(spark):
    d = datetime.date
    families = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")], "family_id string, brand string")
    labels = families.select("family_id", F.lit("2024-06-15").cast("date").alias("prediction_moment"))
    events = spark.createDataFrame(
        [("a1", "A", d(2024, 6, 15)), (None, "A", d(2024, 3, 18)), ("NaN", "A", d(2024, 5, 1)), (None, "A", d(2024, 3, 17)), (None, "A", d(2024, 6, 16)), ("b1", "B", None), ("zz", "A", d(2024, 6, 1))],
        "family_id string, brand string, event_date date",
    )
    got = {r["family_id"]: (r["celebrity_event_count_90d"], r["max_event_date_used"]) for r in features.celebrity_signal(labels, families, events).collect()}
    assert got == {"a1": (3, d(2024, 6, 15)), "a2": (2, d(2024, 5, 1))}
