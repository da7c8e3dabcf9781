"""Registered queries of the warehouse models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import marts
from tidemark.plans.oracle import r, with_
from tidemark.sources import testdata as src

QUERIES = {
    "stg_platforms": lambda s, d: marts.platforms(s),
    "stg_families": lambda s, d: src.families(s, d),
    "stg_sales": lambda s, d: src.sales(s, d).select("family_id", "sold_date", "sold_price_usd", "colorway_tier"),
    "stg_attention": lambda s, d: src.attention(s, d),
    "stg_celebrity_events": lambda s, d: src.celebrity_events(s, d),
    "stg_listings_usd": lambda s, d: marts.listings_usd(s, d).drop("asking_cents", "sold_cents"),
    "stg_retail_usd": lambda s, d: marts.retail_usd(s, d).drop("price_cents"),
    "family_sales": lambda s, d: marts.family_sales(s, d),
    "family_daily_resale": lambda s, d: marts.daily_resale(s, d).drop("cents"),
    "family_liquidity": lambda s, d: marts.liquidity(s, d),
    "brand_retail_baseline": lambda s, d: marts.retail_baseline(s, d),
    "family_price_velocity": lambda s, d: marts.velocity(marts.daily_resale(s, d)).drop("cents", "n_sales"),
    "family_spread": lambda s, d: marts.spread(marts.daily_resale(s, d), src.families(s, d), marts.retail_baseline(s, d)),
    "mart_price_history": lambda s, d: marts.price_history(s, d),
    "mart_current_state": lambda s, d: marts.current_state(s, d),
    "row_count_audit": lambda s, d: _audit(s, d),
}


def _audit(spark, sf_dir):
    """Row counts of the base tables, one small aggregate each."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    out = None
    for n in names:
        one = src.table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


ORACLES = {
    "stg_platforms": with_("SELECT * FROM platforms"),
    "stg_families": with_("SELECT * FROM families"),
    "stg_sales": with_("SELECT family_id, sold_date, sold_price_usd, colorway_tier FROM sales"),
    "stg_attention": with_("SELECT * FROM attention"),
    "stg_celebrity_events": with_("SELECT * FROM events_"),
    "stg_listings_usd": with_("SELECT * EXCLUDE (asking_cents, sold_cents) FROM listings_usd"),
    "stg_retail_usd": with_("SELECT product_id, brand, platform_id, platform_name, price_cents / 100.0 AS price_usd FROM retail JOIN platforms USING (platform_id)"),
    "family_sales": with_("SELECT family_id, sold_date, sold_cents, condition_ordinal FROM listings WHERE family_id IS NOT NULL AND is_sold AND sold_cents IS NOT NULL AND sold_date IS NOT NULL"),
    "family_daily_resale": with_("SELECT family_id, sold_date, sold_price_usd, n_sales FROM daily"),
    "family_liquidity": with_("SELECT * FROM liquidity"),
    "brand_retail_baseline": with_("SELECT * FROM baseline"),
    "family_price_velocity": with_("SELECT * EXCLUDE (cents, n_sales) FROM velocity"),
    "family_spread": with_("SELECT * FROM spread"),
    "mart_price_history": with_(f"""SELECT family_id || ':' || sold_date AS price_history_key, family_id, sold_date, v.sold_price_usd, n_sales,
        {r("sum(cents) OVER (PARTITION BY family_id ORDER BY sold_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / count(cents) OVER (PARTITION BY family_id ORDER BY sold_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 100", 2)} AS rolling_avg_3_sales_usd,
        (cents - lag(cents) OVER (PARTITION BY family_id ORDER BY sold_date)) / 100.0 AS delta_vs_prev_sale_usd, monthly_price_velocity, retail_reference_usd, spread_ratio, spread_basis
        FROM velocity v JOIN spread USING (family_id, sold_date)"""),
    "mart_current_state": with_(f"""SELECT family_id, f.brand, model_line, era, coalesce(n_listings, 0) AS n_listings, coalesce(n_active, 0) AS n_active, coalesce(n_sold, 0) AS n_sold, sold_through_rate,
        last_sold_date, latest_sold_price_usd, med / 100.0 AS median_sold_price_usd, CASE WHEN med > 0 THEN {r('rare / med', 3)} END AS rare_tier_premium_ratio, brand_retail_median_usd,
        CASE WHEN brand_retail_median_usd > 0 THEN {r('latest_sold_price_usd / brand_retail_median_usd', 3)} END AS spread_ratio_latest, 'brand_proxy' AS spread_basis,
        CASE WHEN brand_avg_active > 0 THEN {r('n_active / brand_avg_active', 3)} END AS scarcity_vs_brand
        FROM families f LEFT JOIN liquidity USING (family_id)
        LEFT JOIN (SELECT family_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY price_cents) AS med, percentile_cont(0.5) WITHIN GROUP (ORDER BY price_cents) FILTER (WHERE colorway_tier = 'rare') AS rare FROM sales GROUP BY 1) m USING (family_id)
        LEFT JOIN (SELECT DISTINCT ON (family_id) family_id, sold_date AS last_sold_date, sold_price_usd AS latest_sold_price_usd FROM daily ORDER BY family_id, sold_date DESC) l USING (family_id)
        LEFT JOIN baseline b ON b.brand = f.brand
        LEFT JOIN (SELECT brand, sum(n_active) / count(n_active) AS brand_avg_active FROM liquidity JOIN families USING (family_id) GROUP BY 1) s ON s.brand = f.brand"""),
    "row_count_audit": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]),
}
