"""Staging, intermediate and mart models: lazily composed DataFrames, one Catalyst plan per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio, rounded
from tidemark.sources import testdata as src


def platforms(spark: SparkSession) -> DataFrame:
    return src.values(spark, src.PLATFORMS, "platform_id, platform_name, platform_type")


def fx_rates(spark: SparkSession) -> DataFrame:
    return src.values(spark, src.FX, "currency, usd_per_unit").withColumn("usd_per_unit", F.col("usd_per_unit").cast("double"))


def listings_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with platform name and USD prices; an unknown currency has none. Both dims are a dozen literal rows."""
    base = src.listings(spark, sf_dir).withColumn("currency", F.trim("currency"))
    named = base.join(F.broadcast(platforms(spark).select("platform_id", "platform_name")), "platform_id").join(F.broadcast(fx_rates(spark)), "currency", "left")
    usd = lambda c: rounded(F.col(c) / 100.0 * F.col("usd_per_unit"), 2)
    return named.withColumns({"asking_usd": usd("asking_cents"), "sold_usd": usd("sold_cents")})


def retail_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = src.retail_prices(spark, sf_dir)
    return base.join(F.broadcast(platforms(spark).select("platform_id", "platform_name")), "platform_id").withColumn("price_usd", F.col("price_cents") / 100.0)


def family_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that are sold, dated, priced and belong to a family."""
    kept = src.listings(spark, sf_dir).where("family_id is not null and is_sold and sold_cents is not null and sold_date is not null")
    return kept.select("family_id", "sold_date", "sold_cents", "condition_ordinal")


def daily_resale(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = src.sales(spark, sf_dir).groupBy("family_id", "sold_date").agg(F.sum("price_cents").alias("s"), F.count("*").alias("n_sales"))
    return day.select("family_id", "sold_date", src.half_up_cents("s", "n_sales").alias("cents"), "n_sales").withColumn("sold_price_usd", F.col("cents") / 100.0)


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = src.listings(spark, sf_dir).where("family_id is not null").groupBy("family_id").agg(F.count("*").alias("n_listings"), F.count_if(~F.col("is_sold")).alias("n_active"), F.count_if("is_sold").alias("n_sold"))
    return counts.withColumn("sold_through_rate", rounded(F.col("n_sold") / F.col("n_listings"), 3))


def retail_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = src.retail_prices(spark, sf_dir).where("brand is not null and price_cents is not null").groupBy("brand")
    return base.agg(F.median("price_cents").alias("m"), F.count("*").alias("n_prices")).select("brand", (F.col("m") / 100.0).alias("brand_retail_median_usd"), "n_prices")


def velocity(daily: DataFrame) -> DataFrame:
    """Change from the sale day before, to a 30-day pace."""
    w = Window.partitionBy("family_id").orderBy("sold_date")
    prev, prev_day = F.lag("sold_price_usd").over(w), F.lag("sold_date").over(w)
    out = daily.withColumns({"prev_price_usd": prev, "prev_sold_date": prev_day}).withColumn("days_between_sales", F.datediff("sold_date", "prev_sold_date"))
    pace = (F.col("sold_price_usd") - F.col("prev_price_usd")) / F.col("prev_price_usd") / F.col("days_between_sales") * 30
    return out.withColumn("monthly_price_velocity", F.when((F.col("prev_price_usd") > 0) & (F.col("days_between_sales") > 0), rounded(pace, 4))).drop("prev_sold_date")


def spread(daily: DataFrame, families: DataFrame, baseline: DataFrame) -> DataFrame:
    joined = daily.join(families.select("family_id", "brand"), "family_id").join(baseline.select("brand", "brand_retail_median_usd"), "brand", "left")
    share = rounded(ratio(F.col("sold_price_usd"), F.col("brand_retail_median_usd")), 3)
    return joined.select("family_id", "sold_date", "sold_price_usd", F.col("brand_retail_median_usd").alias("retail_reference_usd"), share.alias("spread_ratio"), F.lit("brand_proxy").alias("spread_basis"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family and sale day: price, rolling mean of three, change, velocity and spread.

    Velocity, rolling mean and change share one window, so daily prices are shuffled and sorted once;
    the family's brand and its baseline are small joins instead of re-joins of the daily relation.
    """
    daily = velocity(daily_resale(spark, sf_dir))
    w = Window.partitionBy("family_id").orderBy("sold_date")
    near = w.rowsBetween(-2, 0)
    daily = daily.withColumns({
        "rolling_avg_3_sales_usd": rounded(F.sum("cents").over(near) / F.count("cents").over(near) / 100, 2),
        "delta_cents": F.col("cents") - F.lag("cents").over(w),
    })
    brands = src.families(spark, sf_dir).select("family_id", "brand").join(retail_baseline(spark, sf_dir), "brand", "left")
    joined = daily.join(brands, "family_id", "left")
    return joined.select(
        F.concat_ws(":", "family_id", F.col("sold_date").cast("string")).alias("price_history_key"), "family_id", "sold_date", "sold_price_usd", "n_sales",
        "rolling_avg_3_sales_usd", (F.col("delta_cents") / 100.0).alias("delta_vs_prev_sale_usd"), "monthly_price_velocity",
        F.col("brand_retail_median_usd").alias("retail_reference_usd"),
        rounded(ratio(F.col("sold_price_usd"), F.col("brand_retail_median_usd")), 3).alias("spread_ratio"), F.lit("brand_proxy").alias("spread_basis"),
    )


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of every family."""
    families = src.families(spark, sf_dir).select("family_id", "brand", "model_line", "era")
    liquid = liquidity(spark, sf_dir)
    sold = src.sales(spark, sf_dir).groupBy("family_id").agg(F.median("price_cents").alias("med"), F.median(F.when(F.col("colorway_tier") == "rare", F.col("price_cents"))).alias("rare"))
    latest = daily_resale(spark, sf_dir).groupBy("family_id").agg(F.max(F.struct("sold_date", "cents")).alias("last"))
    scarce = liquid.join(families.select("family_id", "brand"), "family_id").groupBy("brand").agg((F.sum("n_active") / F.count("n_active")).alias("brand_avg_active"))
    joined = families.join(liquid, "family_id", "left").join(sold, "family_id", "left").join(latest, "family_id", "left").join(retail_baseline(spark, sf_dir), "brand", "left").join(scarce, "brand", "left")
    price = F.col("last.cents") / 100.0
    return joined.select(
        "family_id", "brand", "model_line", "era", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_listings", "n_active", "n_sold")), "sold_through_rate",
        F.col("last.sold_date").alias("last_sold_date"), price.alias("latest_sold_price_usd"), (F.col("med") / 100.0).alias("median_sold_price_usd"),
        rounded(ratio(F.col("rare"), F.col("med")), 3).alias("rare_tier_premium_ratio"), "brand_retail_median_usd",
        rounded(ratio(price, F.col("brand_retail_median_usd")), 3).alias("spread_ratio_latest"), F.lit("brand_proxy").alias("spread_basis"),
        rounded(ratio(F.col("n_active"), F.col("brand_avg_active")), 3).alias("scarcity_vs_brand"),
    )
