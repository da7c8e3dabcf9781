"""As-of features: nothing dated after the prediction moment can reach a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dates import month_of, months_after, within_before
from tidemark.functions.stats import ratio
from tidemark.functions.text import is_archive_era

PEER_FEATURES = ["price_momentum_60d", "sold_velocity_30d", "search_slope_60d", "social_velocity_60d"]
KEY = ["family_id", "prediction_moment"]
# The columns of the feature contract.
COLUMNS = [
    *KEY, "prediction_year", "label", "price_momentum_60d", "sold_velocity_30d", "spread_at_cutoff", "rare_tier_premium", "search_slope_60d", "search_accel",
    "social_velocity_60d", *(f"{c}_peer_z" for c in PEER_FEATURES), "peer_group_size", "celebrity_event_count_90d", "celebrity_recency_days",
    "brand", "category", "collab_flag", "archive_flag", "max_source_date_used",
]

# Allowed ranges of the feature columns.
BOUNDS = {"price_momentum_60d": (-0.95, 20.0), "sold_velocity_30d": (0.0, None), "spread_at_cutoff": (0.0, None), **{f"{c}_peer_z": (-10.0, 10.0) for c in PEER_FEATURES}, "celebrity_event_count_90d": (0, None), "celebrity_recency_days": (0, 90)}


def _age(day: str, low: int, high: int):
    """Between low (inclusive) and high days (exclusive) before the moment."""
    d = F.datediff("prediction_moment", day)
    return (d >= low) & (d < high)


def sales_features(labels: DataFrame, sales: DataFrame) -> DataFrame:
    """Medians of the trailing bands, lower of the middle two, from one join on family and month."""
    j = labels.select(*KEY, month_of("prediction_moment")).join(months_after(sales, "sold_date", 120), ["family_id", "month"]).where(within_before("sold_date", "prediction_moment", 120))
    mid = lambda cond: F.percentile_approx(F.when(cond, F.col("sold_price_usd")), 0.5)
    return j.groupBy(*KEY).agg(
        mid(_age("sold_date", 0, 30)).alias("median_recent"), mid(_age("sold_date", 30, 90)).alias("median_prior"), mid(_age("sold_date", 0, 90)).alias("median_90d"),
        mid(_age("sold_date", 0, 90) & (F.col("colorway_tier") == "rare")).alias("rare_median_90d"), F.count_if(_age("sold_date", 0, 90)).alias("n_sales_90d"), F.max("sold_date").alias("max_sales_date_used"),
    )


def attention_features(labels: DataFrame, attention: DataFrame) -> DataFrame:
    j = labels.select(*KEY, month_of("prediction_moment")).join(months_after(attention, "week_date", 90), ["family_id", "month"]).where(within_before("week_date", "prediction_moment", 90))
    mean = lambda c, lo, hi: F.avg(F.when(_age("week_date", lo, hi), F.col(c)))
    return j.groupBy(*KEY).agg(
        mean("search_interest", 0, 30).alias("interest_0_30"), mean("search_interest", 30, 60).alias("interest_30_60"), mean("search_interest", 60, 90).alias("interest_60_90"),
        mean("social_mentions", 0, 30).alias("mentions_0_30"), mean("social_mentions", 30, 60).alias("mentions_30_60"), F.max("week_date").alias("max_attention_date_used"),
    )


def celebrity_signal(labels: DataFrame, families: DataFrame, events: DataFrame | None) -> DataFrame:
    """Count and latest date of the events of the last 90 days that name the family, or its brand alone.

    The two cases exclude each other, so the disjunction is a union of two equi-joins. Events are counted by
    day before the join; the brand's days are summed once for each of its moments, not for each family.
    """
    base = labels.select(*KEY)
    if events is None:
        return base.limit(0).withColumns({"celebrity_event_count_90d": F.lit(0).cast("long"), "max_event_date_used": F.lit(None).cast("date")})
    e = events.withColumn("family_id", F.when(F.col("family_id") != "NaN", F.col("family_id")))
    days = e.groupBy("family_id", "brand", "event_date").agg(F.count("*").alias("n")).where(F.col("event_date").isNotNull())

    def recent(moments: DataFrame, days: DataFrame, key: str) -> DataFrame:
        j = moments.withColumn("month", month_of("prediction_moment")).join(months_after(days.select(key, "event_date", "n"), "event_date", 90), [key, "month"])
        return j.where(within_before("event_date", "prediction_moment", 90)).groupBy(key, "prediction_moment").agg(F.sum("n").alias("n"), F.max("event_date").alias("last"))

    own = recent(base.distinct(), days.where("family_id is not null"), "family_id")
    branded = base.distinct().join(families.select("family_id", "brand"), "family_id")
    wide = branded.join(recent(branded.select("brand", "prediction_moment").distinct(), days.where("family_id is null"), "brand"), ["brand", "prediction_moment"])
    hit = own.select(*KEY, "n", "last").unionByName(wide.select(*KEY, "n", "last"))
    return hit.groupBy(*KEY).agg(F.sum("n").alias("celebrity_event_count_90d"), F.max("last").alias("max_event_date_used"))


def features(labels: DataFrame, sales: DataFrame, attention: DataFrame, families: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The feature contract: one row per labelled row, peer z-scores within (moment, category)."""
    labels = labels.select(*KEY, "label")
    b = labels.join(sales_features(labels, sales), KEY, "left").join(attention_features(labels, attention), KEY, "left").join(celebrity_signal(labels, families, events), KEY, "left")
    b = b.join(families.select("family_id", "brand", "category", "era", "retail_price_usd", "collab_flag"), "family_id", "left")
    c = F.col
    b = b.withColumns({
        "price_momentum_60d": ratio(c("median_recent"), c("median_prior")) - 1,
        "sold_velocity_30d": F.coalesce(c("n_sales_90d"), F.lit(0)) / 3.0,
        "spread_at_cutoff": ratio(c("median_90d"), c("retail_price_usd")),
        "rare_tier_premium": ratio(c("rare_median_90d"), c("median_90d")) - 1,
        "search_slope_60d": ratio(c("interest_0_30"), c("interest_30_60")) - 1,
        "search_accel": (ratio(c("interest_0_30"), c("interest_30_60")) - 1) - (ratio(c("interest_30_60"), c("interest_60_90")) - 1),
        "social_velocity_60d": (F.coalesce(c("mentions_0_30"), F.lit(0.0)) + 1) / (F.coalesce(c("mentions_30_60"), F.lit(0.0)) + 1) - 1,
        "prediction_year": F.year("prediction_moment"),
        "archive_flag": is_archive_era("era", F.year("prediction_moment")),
        "celebrity_event_count_90d": F.coalesce(c("celebrity_event_count_90d"), F.lit(0)),
        "celebrity_recency_days": F.datediff("prediction_moment", "max_event_date_used").cast("double"),
        "max_source_date_used": F.greatest("max_sales_date_used", "max_attention_date_used", "max_event_date_used"),
    })
    w = Window.partitionBy("prediction_moment", "category")
    b = b.withColumn("peer_group_size", F.count("family_id").over(w))
    z = lambda n: F.when((F.stddev(n).over(w) > 0) & (c("peer_group_size") >= 3), (c(n) - F.avg(n).over(w)) / F.stddev(n).over(w))
    return b.withColumns({f"{n}_peer_z": z(n) for n in PEER_FEATURES}).select(*COLUMNS)


def lookahead_violations(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("max_source_date_used") > F.col("prediction_moment")).alias("n_violations"), F.count("*").alias("n_rows"))


def range_violations(rows: DataFrame) -> DataFrame:
    """Violations of each column's range, all in one pass."""
    bad = []
    for name, (lo, hi) in BOUNDS.items():
        cond = F.lit(False)
        cond = cond | (F.col(name) < lo) if lo is not None else cond
        cond = cond | (F.col(name) > hi) if hi is not None else cond
        bad.append(F.count_if(cond).alias(name))
    one = rows.agg(*bad)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_violations")) for n in BOUNDS))).alias("r")).select("r.*")
