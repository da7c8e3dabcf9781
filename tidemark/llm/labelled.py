"""Bounded samples of labelled documents, the same rows at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True for the documents of the held-out fold: crc32 of the id's digits, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


#: More distinct labels than this are an error: the sample would have no bound.
MAX_LABELS = 64


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y int) of at most per_class labelled documents of each label, least id hash first.

    Null labels, missing documents and null texts do not count; a repeated id has its least label. The
    chosen ids are at most MAX_LABELS times per_class rows of two integers, so that side is broadcast.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    kinds = y.select("y").distinct().limit(MAX_LABELS + 1).count()
    if kinds > MAX_LABELS:
        raise ValueError(f"{label} has over {MAX_LABELS} different values")
    h = F.xxhash64("id")
    there = y.join(texts.select("id"), "id", "left_semi").withColumn("slice", F.shiftright(h, 52))
    # Counts of 4,096 slices of the hash say which of them hold the first rows; only these rows are ranked.
    before = F.sum("n").over(Window.partitionBy("y").orderBy("slice")) - F.col("n")
    slices = there.groupBy("y", "slice").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < per_class)
    first = Window.partitionBy("y").orderBy(h, "id")
    ranked = there.join(F.broadcast(slices.select("y", "slice")), ["y", "slice"]).withColumn("place", F.row_number().over(first))
    chosen = ranked.where(F.col("place") <= per_class).select("id", "y")
    return texts.join(F.broadcast(chosen), "id")
