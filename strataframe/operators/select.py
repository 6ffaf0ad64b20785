"""Deterministic selection: first rows, bounded top-k, hash samples, quotas, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return top_k(df, by, 1, *order)


def top_k(df: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    """At most k rows per stratum; the planner limits groups before and after the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def proportional(df: DataFrame, by: list[str], target: int, priority: Column, key: str) -> DataFrame:
    """max(1, round(target * n / N)) rows per stratum, by priority."""
    strata = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    quota = strata.crossJoin(F.broadcast(strata.agg(F.sum("_n").alias("_all")))).withColumn("_take", F.greatest(F.lit(1), F.rint(target * F.col("_n") / F.col("_all")))).select(*by, "_take")
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(priority, key)))
    return ranked.join(quota, by).where(F.col("_rn") <= F.col("_take")).drop("_rn", "_take")


def tiered(df: DataFrame, by: list[str], k: int, first: Column, priority: Column, key: str) -> DataFrame:
    """Rows of the first tier before others, each by priority, up to k per stratum: reuse and top-up."""
    return top_k(df, by, k, first.desc(), priority, F.col(key))
