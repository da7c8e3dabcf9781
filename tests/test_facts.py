"""Literal cases of the fact builders, the landing zone and the report sink."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts
from tidemark.sources import fixtures, landing

LISTING = "item_id string, family_id string, colorway string, colorway_tier string, platform string, listing_url string, listed_date string, price double, currency string, size_normalized string, condition_ordinal double, sold_date string, sold_price double"


def listing(**values):
    row = dict.fromkeys([c.split()[0] for c in LISTING.split(", ")]) | {"item_id": "i", "platform": "ebay"} | values
    return tuple(row.values())


def test_listing_rows(spark):
    rows = [listing(sold_price=5.0), listing(sold_date="Jun 14, 2026", colorway_tier="rare"), listing(sold_date="soon", condition_ordinal=4.0, colorway_tier=""), listing()]
    got = facts.fact_listings(spark.createDataFrame(rows, LISTING)).collect()
    assert [r["is_sold"] for r in got] == [True, True, False, False]
    assert [r["colorway_tier"] for r in got] == ["unknown", "rare", "unknown", "unknown"]
    assert got[1]["sold_date"] == datetime.date(2026, 6, 14) and got[2]["sold_date"] is None
    assert got[2]["condition_ordinal"] == 4 and got[3]["condition_ordinal"] is None
    assert facts.fact_listings(spark.createDataFrame([], LISTING)).count() == 0


def test_first_seen_of_families(spark):
    rows = [listing(family_id="a", listed_date="2026-03-01"), listing(family_id="a", listed_date="", sold_date="2026-01-05"), listing(family_id=None, listed_date="2020-01-01")]
    families = spark.createDataFrame([("a", "B", "l", "e", None), ("b", "B", "l", "e", "rare")], "family_id string, brand string, model_line string, era string, colorway_tiers string")
    got = {r["family_id"]: r["first_seen_date"] for r in facts.dim_families(families, spark.createDataFrame(rows, LISTING)).collect()}
    assert got == {"a": datetime.date(2026, 1, 5), "b": None}


def test_products_are_in_stock_if_any_variant_is(spark):
    rows = [
        json.dumps({"title": "Boot", "vendor": "RO", "handle": "boot", "variants": [{"price": "90.00", "available": False}, {"price": "95.00", "available": True}]}),
        json.dumps({"title": "Tee", "vendor": "RO", "handle": "tee", "variants": [{"price": "10.00"}, {"available": False}]}),
        json.dumps({"title": "Bare", "vendor": "RO", "handle": "bare", "variants": []}),
    ]
    payload = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", fixtures.PRODUCT).alias("p")).select("p.*")
    got = {r["product_name"]: (r["price"], r["in_stock"]) for r in fixtures.products(payload, "shop.example", "USD", "2026-01-01").collect()}
    assert got == {"Boot": (90.0, True), "Tee": (10.0, False), "Bare": (None, False)}


def test_landing_counts_and_unknown_sources(spark, tmp_path):
    trends = spark.createDataFrame([("k", "2026-01-01", 3)] * 2, fixtures.SCHEMAS["trends"])
    empty = spark.createDataFrame([], fixtures.SCHEMAS["social"])
    counts = landing.land_sources({"trends": trends, "social": empty}, str(tmp_path), fixtures.SOURCES, "20260101T000000Z")
    assert counts == {"trends": 2, "social": 0}
    assert landing.latest(spark, str(tmp_path), "trends", fixtures.SCHEMAS["trends"]).count() == 2
    with pytest.raises(ValueError, match="unknown source 'nowhere'"):
        landing.land_sources({"trends": trends, "nowhere": empty}, str(tmp_path), fixtures.SOURCES, "20260102T000000Z")
    assert landing.latest(spark, str(tmp_path), "trends", fixtures.SCHEMAS["trends"]).count() == 2
    assert re.fullmatch(r"\d{8}T\d{6}Z", landing.run_stamp())


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([(1, 0.5, None)], "n int, rate double, missing string")
    landing.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().asDict() == {"n": 1, "rate": 0.5, "missing": None}
