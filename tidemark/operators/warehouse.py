"""Idempotent loading and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(new: DataFrame, existing: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `existing`, the first landed of each key; NULL keys always differ."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    w = Window.partitionBy(*key).orderBy(*first)
    named = new.where(whole).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(existing.select(*key).distinct(), key, "left_anti")
    return named.select(*new.columns).unionByName(new.where(~whole))


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return df.where(whole).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of all rules in one pass; a NULL outcome passes, as in SQL."""
    one = df.agg(*(F.count_if(~c).alias(n) for n, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules))).alias("r")).select("r.*")


def first_seen(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.coalesce("listed_date", "sold_date")).alias("first_seen_date"))
