"""Literal cases of the text, date, price and metric functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.dates import parse_date
from tidemark.functions.similarity import _lcs, _set_ratio
from tidemark.operators import detect, metrics, pricing, warehouse
from tidemark.operators.graph import components
from tidemark.sources import fixtures, landing


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [("$1,225.00", 1225.0), ("£90", 90.0), ("", None), ("abc", None), (None, None)])
def test_money(spark, text, want):
    assert one(spark, t.parse_money("x"), x=text) == want


@pytest.mark.parametrize("text,want", [("2026-06-14T10:00:00Z", datetime.date(2026, 6, 14)), ("Jun 14, 2026", datetime.date(2026, 6, 14)), ("bad", None), ("", None), (None, None)])
def test_date(spark, text, want):
    assert one(spark, parse_date("x"), x=text) == want


@pytest.mark.parametrize("size,category,want", [("US 9", "footwear", "42"), ("27.5cm", "footwear", "43"), ("43", "footwear", "43"), ("9.5", "footwear", "42.5"), ("UK 5", "footwear", None), ("IT 48", "tops", "M"), ("xl international", "tops", "XL"), ("jp 2", "tops", "M"), ("", "tops", None), (None, "tops", None)])
def test_size(spark, size, category, want):
    assert one(spark, t.normalize_size("s", "c"), s=size, c=category) == want


@pytest.mark.parametrize("text,want", [("New with tags", 5), ("A", 4), ("used, some creasing", 2), ("used_good", 3), ("poor", 1), ("odd", None), (None, None)])
def test_condition(spark, text, want):
    assert one(spark, t.normalize_condition("x"), x=text) == want


@pytest.mark.parametrize("title,tag,want", [("x FW10", None, "FW10"), ("x 03SS y", None, "SS03"), ("aw 09", "", "FW09"), ("SS03", "fw99", "FW99"), ("none", None, None)])
def test_season(spark, title, tag, want):
    assert one(spark, t.extract_season("a", "b"), a=title, b=tag) == want


def test_family_of_a_title(spark):
    title = t.normalize_title(F.lit("Maison Margiela future high top GOLD black size 43"), F.lit("Maison Margiela"))
    assert one(spark, title) == "future high top gold black"
    assert one(spark, t.model_line(F.lit("Maison Margiela"), title)) == "Future High-Top"
    assert one(spark, t.colorway(title)) == "gold/black"
    assert one(spark, t.colorway_tier(F.lit("Maison Margiela"), F.lit("Future High-Top"), t.colorway(title))) == "rare"
    assert one(spark, t.era(F.lit("Maison Margiela"), F.lit("Future High-Top"), F.lit(2013))) == "yeezus-era-2013-2014"
    assert one(spark, t.era(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(1994))) == "1990s"
    assert one(spark, t.normalize_brand(F.lit(None).cast("string"), F.lit("old rick owens drkshdw tee"))) == "Rick Owens"
    assert one(spark, t.normalize_title(F.lit("brown ro boots"), F.lit("Rick Owens"))) == "b wn boots"
    assert one(spark, t.normalize_title(F.lit("brown ro boots"), F.lit("Rick Owens"), word_boundary=True)) == "brown boots"


def test_similarity():
    assert _lcs("scab blouson", "scab jacket") == 5 and _lcs("", "a") == 0
    assert _set_ratio("scab blouson", "scab jacket") == pytest.approx(max(1 - (7 + 6 - 2 * _lcs("blouson", "jacket")) / 23, 1 - 8 / 16, 1 - 7 / 15) * 2 / 3)
    assert _set_ratio("a b c", "a b c d") == 1.0 and _set_ratio("", "x") is None


def test_hold_or_move(spark):
    act = lambda s, d: one(spark, pricing.hold_or_move(F.lit(s).cast("double"), F.lit(d)))["action"]
    assert [act(0.9, 120), act(None, 10), act(0.4, 10), act(0.6, 10)] == ["move", "move", "move", "hold"]


def test_components(spark):
    nodes = spark.range(12).toDF("node")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (7, 8), (8, 8)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(nodes, edges).collect()}
    assert got == {n: {2: 1, 3: 1, 4: 1, 8: 7}.get(n, n) for n in range(12)}


def test_load_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, None, 1), (2, None, 1), (3, "c", 9)], "p int, u string, x int")
    first = warehouse.insert_if_absent(rows, rows.limit(0), ["p", "u"], ["x"])
    assert sorted(map(tuple, first.collect()), key=str) == sorted([(1, "a", 3), (3, "c", 9), (2, None, 1), (2, None, 1)], key=str)
    again = warehouse.insert_if_absent(rows, first, ["p", "u"], ["x"])
    assert [tuple(r) for r in again.collect()] == [(2, None, 1)] * 2


def test_average_precision(spark):
    rows = spark.createDataFrame([("f", None, s, y) for s, y in [(0.9, True), (0.8, False), (0.8, True), (0.1, False)]], "family_id string, cutoff date, score double, label boolean")
    assert metrics.average_precision(rows).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6)


def test_co_mentions(spark):
    texts = spark.createDataFrame([(1, "Playboi Carti in Rick Owens geobasket FW10"), (2, "carti only"), (3, None), (4, "kanye wears undercover")], "id int, text string").selectExpr("id", "text", "'2025-01-01' day", "'reddit:x' source")
    got = {r["id"]: (r["figure"], r["model_line"], r["confidence"], r["family_id"]) for r in detect.co_mentions(texts).collect()}
    assert got == {1: ("Playboi Carti", "Geobasket", 0.9, "rick-owens__geobasket__og-2006-2012"), 4: ("Kanye West", None, 0.6, None)}


def test_platform_payloads(spark, tmp_path):
    path = tmp_path / "ebay.json"
    path.write_text('[{"source":"sold_page","title":"Shop on eBay"},{"source":"sold_page","title":"Boots","sold_price":"$1,225.00","sold_date":"Sold Jun 14, 2026"},{"source":"browse","title":"Tee","price":{"value":"20","currency":"EUR"},"image":{"imageUrl":"u"}},{"source":"odd","title":"x"},{"source":"browse","title":""}]')
    raw = fixtures.scan(spark, "ebay", str(path))
    got = {r["title"]: (r["price"], r["currency"], r["sold_price"], r["sold_date"], r["image_urls"]) for r in fixtures.listings(raw, "ebay").collect()}
    assert got == {"Boots": (None, "USD", 1225.0, "Jun 14, 2026", []), "Tee": (20.0, "EUR", None, None, ["u"])}
    assert sorted(r["reason"] for r in fixtures.rejects(raw, "ebay").collect()) == ["no title", "not a listing", "unknown source"]
    for source in fixtures.RESALE:
        assert fixtures.listings(spark.createDataFrame([], fixtures.SCHEMAS[source]), source).columns == fixtures.LISTING


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1)], "keyword string, interest int")
    landing.land(rows, str(tmp_path), "trends", "20250101T000000Z")
    landing.land(rows.selectExpr("keyword", "2 interest"), str(tmp_path), "trends", "20250201T000000Z")
    assert [tuple(r) for r in landing.latest(spark, str(tmp_path), "trends", "keyword string, interest int").collect()] == [("k", 2)]
    assert landing.latest(spark, str(tmp_path), "none", "a int").count() == 0


def test_stream_upsert(spark, tmp_path):
    from tidemark.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").coalesce(1).write.json(src)
    for run in range(2):
        stream = ingest.landing_stream(spark, src, "k int, v string")
        ingest.upsert(stream, out, ["k"], ["v"], str(tmp_path / f"c{run}")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "c")]
