"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(x: Column | str) -> Column:
    """ISO date in the first ten characters, else 'Jun 14, 2026', else NULL."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.substring(F.trim(c), 1, 10).try_cast("date"), F.try_to_date(F.trim(c), "MMM d, yyyy"))


def within_before(day: Column | str, moment: Column | str, days: int) -> Column:
    """day lies in (moment - days, moment]."""
    d, m = (F.col(x) if isinstance(x, str) else x for x in (day, moment))
    return (d > F.date_sub(m, days)) & (d <= m)


def within_after(day: Column | str, moment: Column | str, days: int) -> Column:
    """day lies in (moment, moment + days]."""
    d, m = (F.col(x) if isinstance(x, str) else x for x in (day, moment))
    return (d > m) & (d <= F.date_add(m, days))


def months_after(rows: DataFrame, day: str, days: int) -> DataFrame:
    """Each row once for every month that holds a moment with `day` in (moment - days, moment]; the first of it is `month`.

    With `month` in the key, an as-of join meets only rows within reach and spreads one family's history over tasks.
    """
    return rows.withColumn("month", F.explode(F.sequence(F.trunc(day, "month"), F.date_add(day, days - 1), F.expr("interval 1 month"))))


def month_of(moment: str) -> Column:
    """The key that months_after gives the rows of this moment."""
    return F.trunc(moment, "month").alias("month")
