"""Streaming twins: keyed de-duplicated ingestion and weekly attention with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.warehouse import insert_if_absent


def landing_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New landing files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def unique_within(stream: DataFrame, key: list[str], time_col: str, delay: str = "7 days") -> DataFrame:
    """Each key once within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)


def weekly_attention(stream: DataFrame, time_col: str = "ts", delay: str = "14 days") -> DataFrame:
    """Interest and mentions by keyword and week, late rows up to the delay."""
    week = F.window(time_col, "7 days")
    return stream.withWatermark(time_col, delay).groupBy(week, "keyword").agg(F.sum("interest").alias("search_interest"), F.count("*").alias("mentions")).select("keyword", F.to_date("window.start").alias("week_date"), "search_interest", "mentions")


def upsert(stream: DataFrame, target: str, key: list[str], first: list[str], checkpoint: str):
    """Append to the Parquet table `target` the rows whose key it does not hold; a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        try:
            existing = batch.sparkSession.read.schema(batch.schema).parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = batch.limit(0)
        insert_if_absent(batch, existing, key, first).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
