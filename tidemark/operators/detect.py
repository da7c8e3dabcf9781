"""Co-mentions of a figure and a brand in one text, at the narrowest grain the text supports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text as t


def co_mentions(texts: DataFrame) -> DataFrame:
    """Events of texts (id, text, day, source): first figure and first brand of the vocabularies that occur together.

    The vocabularies are a few dozen literals folded into one expression, so a text is read once and
    nothing is shuffled.
    """
    padded = t.padded(F.col("text"), "a-z0-9()$é ")
    figure = t.first_of([(reduce(lambda a, b: a | b, (padded.contains(f" {x} ") for x in names)), name) for name, names in vocab.FIGURES.items()])
    found = texts.where(F.length("text") > 0).withColumns({"figure": figure, "brand": t.normalize_brand(F.lit(None).cast("string"), "text"), "folded": F.trim(padded), "season": t.extract_season("text", F.lit(None).cast("string"))})
    found = found.where("figure is not null and brand is not null").withColumn("model_line", t.model_line("brand", "folded"))
    two = F.substring("season", 3, 2).cast("int")
    year = F.coalesce(F.when(two < 90, two + 2000), t.found(F.col("text"), r"\b(19[89]\d|20[0-3]\d)\b").cast("int"))
    pinned = F.when(F.col("model_line").isNotNull() & F.col("year").isNotNull(), t.family_slug("brand", "model_line", t.era("brand", "model_line", "year")))
    return found.withColumn("year", year).select(
        "id", "figure", "brand", "model_line", pinned.alias("family_id"), F.col("day").alias("event_date"), "source",
        F.when(F.col("model_line").isNotNull(), 0.9).otherwise(0.6).alias("confidence"), F.substring("text", 1, 200).alias("evidence"),
    )
