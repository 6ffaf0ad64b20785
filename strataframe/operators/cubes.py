"""Correlation and concordance over grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..storage import materialize
from .ranks import grouped_midranks


def concordance(df: DataFrame, a: str, b: str, x: str, y: str, least: int = 10) -> DataFrame:
    """Per group of the grouping sets (all, all), (a, all), (all, b), (a, b): n, Pearson and Spearman correlation with an interval,
    sign concordance with an interval. A row keeps its four ranks beside it and fans out only into the sums of its groups."""
    sets = {"_all": [], "_a": [a], "_b": [b], "_ab": [a, b]}
    stored = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(a, b, x, y), "cube")
    rows = grouped_midranks(stored, stored, x, {f"{n}_x": g for n, g in sets.items()})
    rows = grouped_midranks(rows, stored, y, {f"{n}_y": g for n, g in sets.items()})
    name = lambda c, g: F.col(c) if c in g else F.lit("All")
    groups = F.array(*[F.struct(name(a, g).alias("g1"), name(b, g).alias("g2"), F.col(f"{n}_x").alias("rx"), F.col(f"{n}_y").alias("ry")) for n, g in sets.items()])
    rows = rows.select(x, y, F.explode(groups).alias("_g")).select(x, y, "_g.*").where("g1 is not null and g2 is not null")
    out = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), stats.correlation(x, y).alias("pearson"), stats.correlation("rx", "ry").alias("spearman"), F.avg(stats.concordant(F.col(x), F.col(y)).cast("double")).alias("concordance")).where(F.col("n") >= least)
    n, r, c = F.col("n"), F.col("spearman"), F.col("concordance")
    return out.select("g1", "g2", "n", "pearson", "spearman", stats.fisher_z(r, n, -1).alias("rho_low"), stats.fisher_z(r, n, 1).alias("rho_high"), "concordance", stats.wald(c, n, -1).alias("conc_low"), stats.wald(c, n, 1).alias("conc_high"))
