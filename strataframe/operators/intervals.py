"""Interval annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_in_interval(points: DataFrame, intervals: DataFrame, on: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points in half-open intervals with an equal key: an equi-join on buckets of `width`, each interval listed under
    the buckets it touches; skewed buckets are split by adaptive execution. Each true pair is found once, since a point has one bucket."""
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    touched = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", touched)
    return p.join(i, [on, "_bucket"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def category_counts(hits: DataFrame, keys: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """Dense counts and flags per key, zero where nothing was hit."""
    wide = hits.groupBy(key).pivot(category, categories).count()
    out = keys.select(key).distinct().join(wide, key, "left").fillna(0, categories)
    flags = [(F.col(c) > 0).cast("int").alias(f"{c}_binary") for c in categories]
    return out.select(key, *[F.col(c).cast("long").alias(f"{c}_raw") for c in categories], *flags, F.greatest(*[F.col(c) > 0 for c in categories], F.lit(False)).cast("int").alias("any"))
