"""Coverage of the label windows."""

import datetime

import pytest

from tidemark.operators import labels


def sales(spark, *days):
    return spark.createDataFrame([(datetime.date(2025, 1, 1) + datetime.timedelta(d),) for d in days], "sold_date date")


def test_moments_need_whole_windows(spark):
    assert [r[0] for r in labels.moments(sales(spark, 0, 130)).collect()] == []
    assert [r[0] for r in labels.moments(sales(spark, 0, 151)).collect()] == [datetime.date(2025, 4, 1)]
    for days in ((0, 100), ()):
        with pytest.raises(ValueError):
            labels.moments(sales(spark, *days))
