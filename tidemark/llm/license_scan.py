"""License scanning by diagonal voting, in DataFrame and SQL functions only.

Every run of three words of a text is hashed and joined to the positions of the same run in the
license templates (a fixed list, so that side is broadcast). A match votes for the diagonal
`position in text - position in template`; votes are counted by diagonal, neighbouring diagonals are
merged into spans (words may be missing or inserted), and a span is verified by the share of the
template's runs that it holds and by its length.

Defined results: a null or empty text has no words, labels or places and score 0; words are maximal
runs of characters other than ASCII ones that are no digit or letter, after lower-casing A-Z; rows that
share an id share its labels; whole texts are read; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import Scratch

K = 3
MIN_SHARE = 0.6
MAX_STRETCH = 1.5
NEAR = 2

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licences, as words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column) -> Column:
    """The hash of the K words from each place on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, K))))


def template_grams(spark: SparkSession) -> DataFrame:
    """(h, template, label, tpos, grams): a few hundred rows, the fixed list above."""
    rows = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    parts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, body)").withColumn("w", F.split("body", " "))
    parts = parts.withColumn("grams", F.size("w") - (K - 1)).select("template", "label", "grams", F.posexplode(F.slice(grams(F.col("w")), F.lit(1), F.col("grams"))).alias("tpos", "h"))
    return parts


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, first_word, end_word, share): verified license notices."""
    spark = df.sparkSession
    rolling = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).select("id", F.posexplode(grams(F.col("w"))).alias("pos", "h"))
    votes = rolling.join(F.broadcast(template_grams(spark)), "h").groupBy("id", "template", "label", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    lines = votes.agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("begin"), (F.max("pos") + K).alias("end"))
    along = Window.partitionBy("id", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    merged = lines.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along)).groupBy("id", "template", "label", "grams", "span")
    spans = merged.agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("begin").alias("first_word"), F.max("end").alias("end_word"))
    share = F.size("places") / F.col("grams")
    fits = (share >= MIN_SHARE) & (F.col("end_word") - F.col("first_word") <= (F.col("grams") + K - 1) * MAX_STRETCH + NEAR)
    return spans.withColumn("share", share).where(fits).select(F.col("id").alias(id_col), "label", "first_word", "end_word", "share")


def _places(words: Column, phrase: str) -> Column:
    """Word positions where the phrase's words stand one after another; arrays are walked only where the words occur."""
    parts = phrase.split()
    at = F.filter(F.transform(words, lambda w, i: F.when(reduce(lambda a, b: a & b, (F.get(words, i + j) == p for j, p in enumerate(parts))), i)), lambda i: i.isNotNull())
    return F.when(F.arrays_overlap(words, F.array(F.lit(parts[0]))), at).otherwise(F.array().cast("array<int>"))


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: word count, places and labels of the fixed phrases, all labels, and a score.

    The score is the largest verified share of a template, 1 where a fixed phrase stands.
    """
    scratch = Scratch(df.sparkSession, "license")
    found = scratch.save(license_spans(df, id_col, text_col).groupBy(id_col).agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "found")
    words = df.select(id_col, words_of(F.col(text_col)).alias("w"))
    spots = words.select(id_col, F.size("w").cast("long").alias("n_words"), *(_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    names = [f"p{i}" for i in range(len(PHRASES))]
    all_places = F.concat(*names)
    base = F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(names, PHRASES.values(), strict=True))), lambda x: x.isNotNull())
    rows = spots.select(id_col, "n_words", all_places.alias("places"), base.alias("base")).join(found, id_col, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
