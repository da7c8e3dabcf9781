"""Landing zone and Parquet sinks: one folder per source and run, the newest run read back."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def land(df: DataFrame, root: str, source: str, run_ts: str) -> None:
    """Append one run of a source as JSON; runs are partitions, so re-reading one prunes the rest."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").json(f"{root}/{source}")


def run_stamp() -> str:
    """The time of a run in UTC, as 20260614T100000Z."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def land_sources(frames: dict[str, DataFrame], root: str, known: Iterable[str], run_ts: str | None = None) -> dict[str, int]:
    """Land one run of several sources; the records landed of each, counted while they are written.

    A source that is not known is an error before anything is written.
    """
    names = sorted(known)
    for source in frames:
        if source not in names:
            raise ValueError(f"unknown source {source!r}; known: {names}")
    stamp, counts = run_ts or run_stamp(), {}
    for source, df in frames.items():
        seen = Observation()
        land(df.observe(seen, F.count(F.lit(1)).alias("n")), root, source, stamp)
        counts[source] = seen.get["n"]
    return counts


def latest(spark: SparkSession, root: str, source: str, schema: str) -> DataFrame:
    """The newest run of a source; a source that never landed is empty."""
    try:
        runs = spark.read.schema(f"{schema}, run_ts string").json(f"{root}/{source}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    newest = runs.agg(F.max("run_ts")).first()[0]
    return runs.where(F.col("run_ts") == newest).drop("run_ts")


def write_features(df: DataFrame, path: str) -> None:
    """Features by year; a rewrite clears years that are gone."""
    df.repartition("prediction_year").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("prediction_year").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON, with its missing values."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("currency string, usd_per_unit decimal(10,6)").csv(path)
