"""Registered queries from payload records to fact rows, with their twins.

The bound relations are written as each source's own JSON and read back with its schema, so the parsers
meet what they meet in a landed file: nested fields, prices and dates as text, missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import facts
from tidemark.plans.oracle import CTE, with_
from tidemark.sources import fixtures
from tidemark.sources import testdata as src

_CONDITIONS = ["poor", "used, some creasing", "used_good", "A", "New with tags"]


def _payload(df: DataFrame, source: str, /, **fields: Column) -> DataFrame:
    """Records of one source as its JSON, read with its schema."""
    record = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    return df.select(F.from_json(record, fixtures.SCHEMAS[source]).alias("p")).select("p.*")


def _resale(s, d) -> DataFrame:
    """Parsed listings of a source with nested fields and of one with two shapes of record."""
    x = src.listings(s, d)
    c = F.col
    number = F.split_part("listing_url", F.lit("-"), F.lit(2)).cast("bigint") * 10 + F.split_part("listing_url", F.lit("-"), F.lit(3)).cast("bigint")
    condition = F.element_at(F.array(*(F.lit(v) for v in _CONDITIONS)), c("condition_ordinal").cast("int"))
    stamp = lambda day: F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'")
    brand = F.split_part("family_id", F.lit("__"), F.lit(1))
    one = _payload(
        x.where("platform_id = 1"), "grailed", id=number, title=c("family_id"), designer=F.struct(brand.alias("name")), price=c("asking_cents") / 100.0, currency=F.trim("currency"), condition=condition,
        created_at=stamp("listed_date"), sold_at=F.when(c("condition_ordinal") == 5, "soon").otherwise(stamp("sold_date")), sold_price=c("sold_cents") / 100.0,
    )
    sold = c("is_sold")
    money = F.concat(F.lit("$"), F.format_number(c("sold_cents") / 100.0, 2))
    two = _payload(
        x.where("platform_id = 2"), "ebay", source=F.when(sold, "sold_page").otherwise("browse"), title=c("family_id"), brand=brand, condition=condition,
        itemWebUrl=F.when(~sold, c("listing_url")), itemCreationDate=F.when(~sold, stamp("listed_date")), price=F.when(~sold, F.struct((c("asking_cents") / 100.0).cast("string").alias("value"), F.trim("currency").alias("currency"))),
        sold_price=money, sold_date=F.concat(F.lit("Sold "), F.date_format("sold_date", "MMM d, yyyy")), listing_url=F.when(sold, c("listing_url")),
    )
    return fixtures.union_resale([fixtures.listings(one, "grailed"), fixtures.listings(two, "ebay")])


def _enriched(s, d) -> DataFrame:
    none = F.lit(None).cast("string")
    item = F.concat(F.lit("item-"), F.substring(F.sha1("listing_url"), 1, 12))
    return _resale(s, d).withColumns({"item_id": item, "family_id": F.col("title"), "colorway": none, "colorway_tier": none, "size_normalized": none, "condition_ordinal": text.normalize_condition("condition")})


def _retail(s, d) -> DataFrame:
    k = F.col("product_id")
    day = F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd")
    return fixtures.retail(_payload(
        src.retail_prices(s, d), "retail", source=F.when(k % 5 == 0, "").otherwise("ssense"), brand=F.col("brand"), product_name=F.concat(F.lit("p"), k.cast("string")), price=F.col("price_cents") / 100.0,
        currency=F.lit("USD"), in_stock=F.when(k % 4 > 1, k % 4 == 2), date=F.when(k % 3 > 0, day),
    ))


def _search(s, d) -> DataFrame:
    return fixtures.trends(_payload(src.attention(s, d), "trends", keyword=F.col("family_id"), date=F.col("week_date").cast("string"), interest=F.col("search_interest").cast("int")))


def _social(s, d) -> DataFrame:
    return fixtures.social(_payload(
        src.table(s, d, "events"), "social", subreddit=F.col("event_type"), post_id=F.concat(F.lit("e"), F.col("event_id").cast("string")), title=F.col("props"),
        created_date=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), score=F.when(F.col("user_id") % 7 > 0, F.floor("value").cast("int")),
    ))


def _sightings(s, d) -> DataFrame:
    none = F.lit(None).cast("string")
    sure = F.when(F.col("family_id").isNotNull(), 0.9).otherwise(0.6)
    x = src.celebrity_events(s, d).withColumn("event_date", F.date_format("event_date", "MMM d, yyyy"))
    return x.withColumns({"model_line": none, "figure": F.lower("brand"), "source": F.concat(F.lit("reddit:"), "brand"), "confidence": sure, "evidence": none})


def _dimension(s, d) -> DataFrame:
    tiers = src.sales(s, d).groupBy("family_id").agg(F.array_join(F.array_sort(F.collect_set("colorway_tier")), ",").alias("colorway_tiers"))
    return facts.dim_families(src.families(s, d).join(tiers, "family_id", "left"), _enriched(s, d))


QUERIES = {
    "fact_listing_rows": lambda s, d: facts.fact_listings(_enriched(s, d)).drop("colorway", "size_normalized"),
    "fact_retail_rows": lambda s, d: facts.fact_retail(_retail(s, d)).drop("product_url"),
    "fact_search_rows": lambda s, d: facts.fact_search(_search(s, d)),
    "fact_social_rows": lambda s, d: facts.fact_social(_social(s, d)).drop("post_url"),
    "fact_celebrity_rows": lambda s, d: facts.fact_celebrity(_sightings(s, d)).drop("model_line", "evidence"),
    "dim_family_rows": _dimension,
    "not_null_violations": lambda s, d: facts.not_null_violations(facts.fact_listings(_enriched(s, d)), ["item_id", "platform_name", "listing_url", "listed_date", "sold_date", "is_sold"]),
}

CTE.update({
    "parsed_listings": """SELECT family_id, 'grailed' AS platform_name, 'https://www.grailed.com/listings/' || (CAST(split_part(listing_url, '-', 2) AS BIGINT) * 10 + CAST(split_part(listing_url, '-', 3) AS BIGINT)) AS listing_url, listed_date, asking_cents / 100.0 AS asking_price,
        trim(currency) AS currency, condition_ordinal, CASE WHEN condition_ordinal <> 5 THEN sold_date END AS sold_date, sold_cents / 100.0 AS sold_price FROM listings WHERE platform_id = 1
        UNION ALL SELECT family_id, 'ebay', listing_url, CASE WHEN NOT is_sold THEN listed_date END, CASE WHEN NOT is_sold THEN asking_cents / 100.0 END, CASE WHEN is_sold THEN 'USD' ELSE trim(currency) END, condition_ordinal, sold_date, sold_cents / 100.0 FROM listings WHERE platform_id = 2""",
    "fact_rows": "SELECT 'item-' || left(sha1(listing_url), 12) AS item_id, family_id, 'unknown' AS colorway_tier, platform_name, listing_url, listed_date, asking_price, currency, CAST(condition_ordinal AS SMALLINT) AS condition_ordinal, sold_price IS NOT NULL OR sold_date IS NOT NULL AS is_sold, sold_date, sold_price FROM parsed_listings",
})

ORACLES = {
    "fact_listing_rows": with_("SELECT * FROM fact_rows"),
    "fact_retail_rows": with_("""SELECT CASE WHEN product_id % 5 = 0 THEN 'unknown' ELSE 'ssense' END AS platform_name, brand, 'p' || product_id AS product_name, CASE WHEN product_id % 3 > 0 THEN DATE '1998-01-01' + CAST(product_id % 365 AS INTEGER) END AS observed_date,
        price_cents / 100.0 AS retail_price, 'USD' AS currency, product_id % 4 <> 3 AS in_stock FROM retail"""),
    "fact_search_rows": with_("SELECT family_id AS keyword, week_date AS observed_date, CAST(search_interest AS INTEGER) AS interest_index FROM attention"),
    "fact_social_rows": "SELECT event_type AS subreddit, 'e' || event_id AS post_id, props AS title, CAST(ts AS DATE) AS created_date, CASE WHEN user_id % 7 > 0 THEN coalesce(CAST(floor(value) AS INTEGER), 0) ELSE 0 END AS score, 0 AS num_comments FROM events",
    "fact_celebrity_rows": with_("SELECT family_id, brand, lower(brand) AS figure, event_date, 'reddit:' || brand AS source, CASE WHEN family_id IS NOT NULL THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM events_"),
    "dim_family_rows": with_("""SELECT f.family_id, brand, model_line, era, colorway_tiers, first_seen_date FROM families f LEFT JOIN (SELECT family_id, string_agg(DISTINCT colorway_tier, ',' ORDER BY colorway_tier) AS colorway_tiers FROM sales GROUP BY 1) USING (family_id)
        LEFT JOIN (SELECT family_id, min(coalesce(listed_date, sold_date)) AS first_seen_date FROM parsed_listings GROUP BY 1) USING (family_id)"""),
    "not_null_violations": with_(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_violations FROM fact_rows" for c in ("item_id", "platform_name", "listing_url", "listed_date", "sold_date", "is_sold"))),
}
