"""The market relations, bound to the star-schema test tables.

families, sales, attention, events, listings and retail prices are views over part, lineitem, orders
and supplier, so that every operator runs on tables of any size. Prices are whole cents: sums of cents
are exact in any order, which keeps results the same for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import slug

# Currency to USD, and the platforms.
FX = [("USD", 1.0), ("EUR", 1.09), ("GBP", 1.27), ("JPY", 0.0063)]
PLATFORMS = [
    (1, "grailed", "resale"), (2, "ebay", "resale"), (3, "depop", "resale"), (4, "vestiaire", "resale"),
    (5, "therealreal", "resale"), (6, "secondstreet", "resale"), (7, "shopify", "retail"), (8, "ssense", "retail"),
    (9, "saks", "retail"), (10, "google_trends", "search"), (11, "reddit", "social"),
]
ERAS = ["archive-golden", "1990-1994-run", "recent-wave", "era-unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small literal relation that stays inside the plan."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def _generation() -> Column:
    return F.floor((F.col("p_size") - 1) / 13).cast("int")


def _family_id() -> Column:
    return F.concat(slug("p_brand"), F.lit("__"), slug("p_type"), F.lit("__g"), _generation().cast("string"))


def part_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part key to family key."""
    return table(spark, sf_dir, "part").select("p_partkey", _family_id().alias("family_id"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    grouped = part.groupBy(_family_id().alias("family_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), _generation().alias("g"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    out = grouped.agg(F.sum(cents).alias("s"), F.count("*").alias("n"), (F.min("p_partkey") % 2 == 0).alias("collab_flag"))
    era = F.element_at(F.array(*map(F.lit, ERAS)), F.col("g") + 1)
    return out.select("family_id", "brand", "category", F.concat(F.lit("g"), F.col("g").cast("string")).alias("model_line"), era.alias("era"), (half_up_cents("s", "n") / 100.0).alias("retail_price_usd"), "collab_flag")


def half_up_cents(total: str, n: str) -> Column:
    """Mean of whole cents, rounded half up to whole cents, in integers."""
    return F.expr(f"(2 * {total} + {n}) div (2 * {n})")


def price_cents() -> Column:
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sale: family, day, price in cents and USD, colourway tier."""
    tier = F.when(F.col("l_returnflag") == "R", "rare").when(F.col("l_returnflag") == "A", "core").otherwise("standard")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("sold_date"), price_cents().alias("price_cents"), tier.alias("colorway_tier"))
    return line.join(part_families(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).select("family_id", "sold_date", "price_cents", (F.col("price_cents") / 100.0).alias("sold_price_usd"), "colorway_tier")


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly interest and mentions of each family."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_date"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part_families(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("family_id", "week_date").agg(F.sum("l_quantity").alias("search_interest"), F.count_distinct("o_custkey").alias("social_mentions"))


def celebrity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one family (first line of an urgent order) or of a whole brand (second line)."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.to_date("o_orderdate").alias("event_date"))
    line = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _family_id().alias("f"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.when(F.col("l_linenumber") == 1, F.col("f")).alias("family_id"), F.col("p_brand").alias("brand"), "event_date")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform listings with padded currency codes and nullable sale columns."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part_families(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    currency = F.element_at(F.array(*(F.lit(c) for c in ("USD ", "EUR ", "GBP ", "JPY ", "CHF "))), F.col("s_nationkey") % 5 + 1)
    sold = F.col("l_returnflag") != "N"
    return line.select(
        F.concat_ws("-", F.lit("L"), "l_orderkey", "l_linenumber").alias("listing_url"), (F.col("s_nationkey") % 6 + 1).alias("platform_id"), "family_id",
        F.to_date("l_shipdate").alias("listed_date"), price_cents().alias("asking_cents"), currency.alias("currency"), sold.alias("is_sold"),
        F.when(sold, F.to_date("l_shipdate")).alias("sold_date"), F.when(F.col("l_returnflag") == "R", price_cents()).alias("sold_cents"),
        (F.col("l_linenumber") % 5 + 1).alias("condition_ordinal"),
    )


def retail_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"), (F.col("p_partkey") % 3 + 7).cast("int").alias("platform_id"))
