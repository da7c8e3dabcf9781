"""Parsed records to the rows of the warehouse: five fact tables and the family dimension.

Every date goes through one parser; a text that is no date is NULL. Records may lack values but not the
columns. Keys are not checked here: the loader drops repeated keys and the audits count orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date


def is_sold(price: str | Column = "sold_price", day: str | Column = "sold_date") -> Column:
    """A listing is sold if it has a sale price, or a sale date that can be read."""
    price = F.col(price) if isinstance(price, str) else price
    return price.isNotNull() | parse_date(day).isNotNull()


def fact_listings(listings: DataFrame) -> DataFrame:
    """Normalised listings as fact rows; the tier is never NULL, the condition a small integer."""
    return listings.select(
        "item_id", "family_id", "colorway", F.coalesce(F.when(F.col("colorway_tier") != "", F.col("colorway_tier")), F.lit("unknown")).alias("colorway_tier"),
        F.col("platform").alias("platform_name"), "listing_url", parse_date("listed_date").alias("listed_date"), F.col("price").alias("asking_price"), "currency",
        "size_normalized", F.col("condition_ordinal").cast("smallint").alias("condition_ordinal"), is_sold().alias("is_sold"), parse_date("sold_date").alias("sold_date"), "sold_price",
    )


def fact_retail(records: DataFrame) -> DataFrame:
    """Shop prices; a record that says nothing of its stock is in stock."""
    return records.select(
        F.col("source").alias("platform_name"), "brand", "product_name", F.col("url").alias("product_url"), parse_date("date").alias("observed_date"),
        F.col("price").alias("retail_price"), "currency", F.coalesce("in_stock", F.lit(True)).alias("in_stock"),
    )


def fact_search(records: DataFrame) -> DataFrame:
    return records.select("keyword", parse_date("date").alias("observed_date"), F.col("interest").cast("int").alias("interest_index"))


def fact_social(records: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    return records.select("subreddit", "post_id", "title", F.col("url").alias("post_url"), parse_date("created_date").alias("created_date"), count("score"), count("num_comments"))


def fact_celebrity(records: DataFrame) -> DataFrame:
    """Sightings; family and model line are NULL where the text named a brand only."""
    return records.select("family_id", "brand", "model_line", "figure", parse_date("event_date").alias("event_date"), "source", "confidence", "evidence")


def dim_families(families: DataFrame, listings: DataFrame) -> DataFrame:
    """Families with the first day on which one of their listings was listed (or sold, where that is unknown)."""
    day = F.coalesce(parse_date("listed_date"), parse_date("sold_date"))
    first = listings.where(F.col("family_id").isNotNull()).groupBy("family_id").agg(F.min(day).alias("first_seen_date"))
    return families.select("family_id", "brand", "model_line", "era", "colorway_tiers").join(first, "family_id", "left")


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_violations) of columns that must not be NULL, in one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_violations")) for c in columns))).alias("r")).select("r.*")
