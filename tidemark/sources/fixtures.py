"""Platform payloads to listings: nested JSON arrays read with explicit schemas, one select per source.

A record without a title is rejected, as are sold cards that are no listing; rejects() gives them back
with the reason instead of a log line.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import null_if_empty, parse_money

LISTING = ["platform", "title", "brand", "price", "currency", "size", "condition", "listing_url", "listed_date", "sold_date", "sold_price", "image_urls", "seller", "collection_tag"]

SCHEMAS = {
    "grailed": "id bigint, title string, designer struct<name: string>, price double, currency string, size string, condition string, created_at string, sold_at string, sold_price double, cover_photo struct<url: string>, user struct<username: string>, season string",
    "ebay": "source string, title string, brand string, itemId string, itemWebUrl string, itemCreationDate string, price struct<value: string, currency: string>, condition string, size string, image struct<imageUrl: string>, seller struct<username: string>, sold_price string, sold_date string, listing_url string, currency string",
    "depop": "id bigint, title string, description string, brand_name string, price struct<total_price: string, currency_name: string>, sizes array<struct<name: string>>, condition string, slug string, preview struct<`640`: string>, date_updated string, seller_username string",
    "vestiaire": "id bigint, name string, brand struct<name: string>, price struct<cents: bigint, amount: string, currency: string>, size struct<label: string>, condition struct<label: string>, link string, pictures array<string>, seller struct<nickname: string>, created_at string",
    "therealreal": "sku string, name string, designer string, price string, currency string, size string, condition string, url string, image string, first_listed string, sold_date string, sold_price string",
    "secondstreet": "title string, brand string, price string, currency string, size string, condition string, url string, listed_date string, image_urls array<string>",
    "retail": "source string, brand string, product_name string, price double, currency string, url string, in_stock boolean, date string",
    "trends": "keyword string, date string, interest int",
    "social": "subreddit string, post_id string, title string, url string, created_date string, score int, num_comments int",
}

# Addresses of the platforms' pages.
URLS = {"grailed": "https://www.grailed.com/listings/", "depop": "https://www.depop.com/products/", "vestiaire": "https://www.vestiairecollective.com", "therealreal": "https://www.therealreal.com"}


def scan(spark: SparkSession, source: str, path: str) -> DataFrame:
    """A JSON array file of one source."""
    return spark.read.schema(SCHEMAS[source]).option("multiLine", True).json(path)


def live_mode(*needed: str) -> bool:
    """Live connectors need the switch and every credential; this build reads files only."""
    return os.environ.get("INGEST_LIVE") == "1" and all(os.environ.get(n) for n in needed)


def _c(name: str) -> Column:
    return F.col(name)


def _present(x: Column) -> Column:
    return F.array_compact(F.array(x))


def _columns(source: str) -> dict[str, Column]:
    number = lambda x: x.cast("double")
    nothing, none = F.lit(None).cast("double"), F.lit(None).cast("string")
    browse = _c("source") == "browse"
    if source == "grailed":
        return dict(title=_c("title"), brand=_c("designer.name"), price=number(_c("price")), currency=F.coalesce(null_if_empty(_c("currency")), F.lit("USD")), size=_c("size"), condition=_c("condition"), listing_url=F.concat(F.lit(URLS[source]), _c("id").cast("string")), listed_date=_c("created_at"), sold_date=_c("sold_at"), sold_price=number(_c("sold_price")), image_urls=_present(_c("cover_photo.url")), seller=_c("user.username"), collection_tag=_c("season"))
    if source == "ebay":
        sold_day = null_if_empty(F.trim(F.regexp_replace(_c("sold_date"), "^Sold", "")))
        return dict(title=_c("title"), brand=_c("brand"), price=F.when(browse, parse_money("price.value")), currency=F.when(browse, _c("price.currency")).otherwise(F.coalesce(null_if_empty(_c("currency")), F.lit("USD"))), size=_c("size"), condition=_c("condition"), listing_url=F.when(browse, _c("itemWebUrl")).otherwise(_c("listing_url")), listed_date=F.when(browse, _c("itemCreationDate")), sold_date=F.when(~browse, sold_day), sold_price=F.when(~browse, parse_money("sold_price")), image_urls=_present(_c("image.imageUrl")), seller=_c("seller.username"), collection_tag=none)
    if source == "depop":
        return dict(title=F.coalesce(null_if_empty(_c("title")), _c("description")), brand=_c("brand_name"), price=parse_money("price.total_price"), currency=_c("price.currency_name"), size=F.get("sizes", F.lit(0))["name"], condition=_c("condition"), listing_url=F.concat(F.lit(URLS[source]), null_if_empty(_c("slug")), F.lit("/")), listed_date=_c("date_updated"), sold_date=none, sold_price=nothing, image_urls=_present(_c("preview.`640`")), seller=_c("seller_username"), collection_tag=none)
    if source == "vestiaire":
        return dict(title=_c("name"), brand=_c("brand.name"), price=F.coalesce(_c("price.cents") / 100, parse_money("price.amount")), currency=_c("price.currency"), size=_c("size.label"), condition=_c("condition.label"), listing_url=F.concat(F.lit(URLS[source]), null_if_empty(_c("link"))), listed_date=_c("created_at"), sold_date=none, sold_price=nothing, image_urls=F.coalesce(_c("pictures"), F.array().cast("array<string>")), seller=_c("seller.nickname"), collection_tag=none)
    if source == "therealreal":
        url = F.when(_c("url").startswith("http"), _c("url")).otherwise(F.concat(F.lit(URLS[source]), null_if_empty(_c("url"))))
        return dict(title=_c("name"), brand=_c("designer"), price=parse_money("price"), currency=F.coalesce(null_if_empty(_c("currency")), F.lit("USD")), size=_c("size"), condition=_c("condition"), listing_url=url, listed_date=_c("first_listed"), sold_date=_c("sold_date"), sold_price=parse_money("sold_price"), image_urls=_present(_c("image")), seller=none, collection_tag=none)
    if source == "secondstreet":
        return dict(title=_c("title"), brand=_c("brand"), price=parse_money("price"), currency=_c("currency"), size=_c("size"), condition=_c("condition"), listing_url=_c("url"), listed_date=_c("listed_date"), sold_date=none, sold_price=nothing, image_urls=F.coalesce(_c("image_urls"), F.array().cast("array<string>")), seller=none, collection_tag=none)
    raise ValueError(f"unknown resale source: {source}")


def _fault(source: str, title: Column) -> Column:
    """Why a payload is no listing; NULL for a good one."""
    fault = F.when(F.coalesce(F.length(title), F.lit(0)) == 0, "no title")
    if source == "ebay":
        fault = F.when(~F.coalesce(_c("source").isin("browse", "sold_page"), F.lit(False)), "unknown source").when(F.coalesce(F.length(title), F.lit(0)) == 0, "no title").when((_c("source") == "sold_page") & F.lower(title).startswith("shop on ebay"), "not a listing")
    return fault


def listings(payload: DataFrame, source: str) -> DataFrame:
    cols = _columns(source)
    good = payload.where(_fault(source, cols["title"]).isNull())
    return good.select(F.lit(source).alias("platform"), *(cols[c].alias(c) for c in LISTING[1:]))


def rejects(payload: DataFrame, source: str) -> DataFrame:
    cols = _columns(source)
    return payload.select(F.to_json(F.struct("*")).alias("record"), _fault(source, cols["title"]).alias("reason")).where("reason is not null")


def retail(payload: DataFrame) -> DataFrame:
    d = lambda c, v: F.coalesce(null_if_empty(_c(c)), F.lit(v)).alias(c)
    return payload.where(F.length("product_name") > 0).select(d("source", "unknown"), "brand", "product_name", "price", "currency", "url", F.coalesce("in_stock", F.lit(True)).alias("in_stock"), d("date", ""))


#: A shop's product listing.
PRODUCT = "vendor string, title string, handle string, variants array<struct<price: string, available: boolean>>"


def products(payload: DataFrame, shop: str, currency: str, day: str) -> DataFrame:
    """Products of a shop's listing as retail records: the first variant's price, in stock if any variant is."""
    first = F.get("variants", F.lit(0))["price"]
    stocked = F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False)))
    return payload.where(F.length("title") > 0).select(
        F.lit(shop).alias("source"), F.col("vendor").alias("brand"), F.col("title").alias("product_name"), parse_money(first).alias("price"), F.lit(currency).alias("currency"),
        F.concat(F.lit(f"https://{shop}/products/"), "handle").alias("url"), F.coalesce(stocked, F.lit(False)).alias("in_stock"), F.lit(day).alias("date"),
    )


def trends(payload: DataFrame) -> DataFrame:
    return payload.select("keyword", "date", F.col("interest").cast("int").alias("interest"))


def social(payload: DataFrame) -> DataFrame:
    return payload.select("subreddit", "post_id", "title", "url", "created_date", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("score", "num_comments")))


def social_texts(posts: DataFrame) -> DataFrame:
    """Posts as texts for event detection."""
    return posts.select(F.col("post_id").alias("id"), F.col("title").alias("text"), F.col("created_date").alias("day"), F.concat(F.lit("reddit:"), "subreddit").alias("source"))


RESALE = ["grailed", "ebay", "depop", "vestiaire", "therealreal", "secondstreet"]
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {**{s: (lambda df, s=s: listings(df, s)) for s in RESALE}, "retail": retail, "trends": trends, "social": social}


def union_resale(parsed: list[DataFrame]) -> DataFrame:
    out = parsed[0]
    for df in parsed[1:]:
        out = out.unionByName(df)
    return out
