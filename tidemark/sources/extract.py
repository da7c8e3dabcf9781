"""Extraction from HTML and JSON strings by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every anchor, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def first_tag(pages: DataFrame, tag: str) -> DataFrame:
    """The text of the first element of that name, NULL when absent or blank."""
    body = F.trim(F.regexp_extract("html", f"<{tag}[^>]*>([^<]*)</{tag}>", 1))
    return pages.select("page_id", F.when(body != "", body).alias(tag))


def script_value(pages: DataFrame, pattern: str) -> DataFrame:
    """The first group of the pattern within the first script, which ends at its closing tag."""
    script = F.regexp_extract("html", r"(?s)<script[^>]*>(.*?)</script>", 1)
    got = F.regexp_extract(script, pattern, 1)
    return pages.select("page_id", F.when(got != "", got).alias("found"))


def embedded_json(pages: DataFrame, marker: str, schema: str) -> DataFrame:
    """(page_id, item): the array in the JSON body of the script with that marker; unreadable bodies give no rows."""
    body = F.regexp_extract("html", rf"(?s)<script[^>]*{marker}[^>]*>(.*?)</script>", 1)
    return pages.select("page_id", F.explode(F.from_json(body, schema)).alias("item"))


def cards(pages: DataFrame, title_class: str, price_class: str) -> DataFrame:
    """(page_id, pos, title, price) of listing cards by the class names of their parts."""
    part = lambda c: F.regexp_extract_all("html", F.lit(rf'class="[^"]*{c}[^"]*"[^>]*>\s*([^<]*)<'), F.lit(1))
    return pages.select("page_id", F.posexplode(F.arrays_zip(part(title_class).alias("title"), part(price_class).alias("price"))).alias("pos", "card")).select("page_id", "pos", "card.title", "card.price")


def props(events: DataFrame) -> DataFrame:
    """Events with the number in their JSON properties."""
    return events.select("event_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))
