"""Plain tests on tables of counts, ranks and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chi_square(df: DataFrame, by: list[str], row: str, flag: str) -> DataFrame:
    """Pearson's statistic of a table of three rows and two columns per group, without correction, and its p (two degrees
    of freedom, so exp(-x / 2)); a table with an empty margin has p = 1."""
    cells = df.groupBy(*by, row).agg(F.count_if(F.col(flag)).cast("double").alias("_a"), F.count_if(~F.col(flag)).cast("double").alias("_b"))
    sums = cells.groupBy(*by).agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.count(F.lit(1)).alias("_rows"))
    n, r = F.col("_sa") + F.col("_sb"), F.col("_a") + F.col("_b")
    part = lambda o, s: F.try_divide(F.pow(F.col(o) - r * F.col(s) / n, F.lit(2.0)), r * F.col(s) / n)
    d = cells.join(sums, by).groupBy(*by, "_rows", "_sa", "_sb").agg(F.sum(F.coalesce(part("_a", "_sa"), F.lit(0.0)) + F.coalesce(part("_b", "_sb"), F.lit(0.0))).alias("chi2"))
    whole = (F.col("_rows") == 3) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return d.select(*by, F.when(whole, F.col("chi2")).alias("chi2"), F.when(whole, F.exp(-F.col("chi2") / 2)).otherwise(1.0).alias("p"))


def mann_whitney(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """U of the first sample and its normal deviate, corrected for ties and without continuity. Rows are summed by value first."""
    d = df.groupBy(*by, value).agg(F.count_if(first).cast("double").alias("_a"), F.count_if(~first).cast("double").alias("_b"))
    below = F.coalesce(F.sum("_b").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = F.col("_a") + F.col("_b")
    s = d.withColumn("_below", below).groupBy(*by).agg(F.sum(F.col("_a") * (F.col("_below") + F.col("_b") / 2)).alias("u"), F.sum("_a").alias("_n"), F.sum("_b").alias("_m"), F.sum(t * t * t - t).alias("_t"))
    n = F.col("_n") + F.col("_m")
    sd = F.sqrt(F.col("_n") * F.col("_m") / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    return s.select(*by, "u", ((F.col("u") - F.col("_n") * F.col("_m") / 2) / sd).alias("z"))


def heterogeneity(estimates: DataFrame, by: list[str], value: str, se: str) -> DataFrame:
    """Cochran's Q of three groups' estimates, with the pooled estimate and p (two degrees of freedom)."""
    w = 1 / (F.col(se) * F.col(se))
    d = estimates.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.sum(w).alias("_w"), F.sum(w * F.col(value)).alias("_wx"), F.sum(w * F.col(value) * F.col(value)).alias("_wxx"))
    q = F.col("_wxx") - F.col("_wx") * F.col("_wx") / F.col("_w")
    return d.select(*by, "groups", (F.col("_wx") / F.col("_w")).alias("pooled"), q.alias("q"), F.when(F.col("groups") == 3, F.exp(-q / 2)).alias("p"))


def percentile_among(df: DataFrame, by: list[str], value: str, one: Column, others: Column, least: int) -> DataFrame:
    """For the rows of `one`, the share of the group's `others` below them, equal ones by half, in groups with at least `least` others."""
    w = W.partitionBy(*by)
    low = F.when(others, 1).otherwise(0)
    upto, equal = F.sum(low).over(w.orderBy(value).rangeBetween(W.unboundedPreceding, 0)), F.sum(low).over(W.partitionBy(*by, value))
    ranked = df.withColumns({"others": F.sum(low).over(w), "_upto": upto, "_equal": equal}).where(one & (F.col("others") >= least))
    return ranked.withColumn("percentile", (F.col("_upto") - F.col("_equal") / 2.0) / F.col("others")).drop("_upto", "_equal")
