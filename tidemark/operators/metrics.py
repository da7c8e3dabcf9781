"""Ranking and classification metrics in a fixed number of passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import rounded


def at_k(scored: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """precision@k and recall@k; the largest k rows are all that is sorted globally."""
    top = scored.orderBy(F.desc_nulls_last("score"), "family_id", "cutoff").limit(max(ks)).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "family_id", "cutoff")))
    hits = top.agg(*(F.count_if((F.col("place") <= k) & F.col("label")).alias(f"h{k}") for k in ks), *(F.count_if(F.col("place") <= k).alias(f"n{k}") for k in ks))
    both = hits.join(scored.agg(F.count_if("label").alias("positives")), F.lit(True))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), rounded(F.try_divide(F.col(f"h{k}"), F.col(f"n{k}")), 6).alias("precision"), rounded(F.try_divide(F.col(f"h{k}"), F.col("positives")), 6).alias("recall")) for k in ks))
    return both.select(F.explode(rows).alias("r")).select("r.*")


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = F.coalesce(F.col("score") >= threshold, F.lit(False))
    c = scored.agg(F.count("*").alias("n_rows"), F.count_if("label").alias("positives"), F.count_if(p & F.col("label")).alias("tp"), F.count_if(p & ~F.col("label")).alias("fp"))
    share = lambda a, b: F.coalesce(rounded(F.try_divide(F.col(a), b), 6), F.lit(0.0))
    return c.select("n_rows", "positives", "tp", "fp", share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("positives")).alias("recall"))


def average_precision(scored: DataFrame, buckets: int = 64) -> DataFrame:
    """Area under the precision-recall steps; rows of equal score form one step.

    Scores are grouped first. The running totals come in two levels, within ranges of the score and
    over the ranges' sums, so no single task sorts all distinct scores.
    """
    steps = scored.groupBy("score").agg(F.count_if("label").alias("tp"), F.count("*").alias("n"))
    part = steps.withColumn("range", F.least(F.floor(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) * buckets), F.lit(buckets - 1)))
    sums = part.groupBy("range").agg(F.sum("tp").alias("rtp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("rtp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = part.join(F.broadcast(sums), "range").select("tp", (F.sum("tp").over(w) + F.col("tp0")).alias("ctp"), (F.sum("n").over(w) + F.col("n0")).alias("cn"))
    area = run.agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("a"), F.sum("tp").alias("p"))
    return area.select(rounded(F.coalesce(F.try_divide("a", "p"), F.lit(0.0)), 6).alias("average_precision"), F.col("p").alias("positives"))


def time_split(rows: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the day, and from it on; never a random split. Both sides must hold rows, the first positives."""
    train, test = rows.where(F.col("cutoff") < F.lit(day).cast("date")), rows.where(F.col("cutoff") >= F.lit(day).cast("date"))
    n = rows.agg(F.count_if(F.col("cutoff") < F.lit(day).cast("date")).alias("a"), F.count_if(F.col("cutoff") >= F.lit(day).cast("date")).alias("b"), F.count_if((F.col("cutoff") < F.lit(day).cast("date")) & F.col("label")).alias("p")).first()
    if not (n["a"] and n["b"] and n["p"]):
        raise ValueError(f"split at {day}: {n['a']} rows before with {n['p']} positives, {n['b']} after")
    return train, test


def importance_shares(importances: DataFrame) -> DataFrame:
    """Shares of the total and ranks of at most a few dozen features."""
    return importances.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
