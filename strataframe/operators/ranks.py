"""Rank and order operators as windows; every order ends in a total key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

UP = (W.unboundedPreceding, W.currentRow)


def midrank(x: str, by: list[str]) -> Column:
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*by, x)) - 1) / F.lit(2.0)


def ranged_midrank(df: DataFrame, x: str, by: list[str], name: str, ranges: int = 64) -> DataFrame:
    """midrank() for groups of any size: a group is cut into ranges of values at approximate quantiles, ranks are taken within a
    range, and the rows of the ranges before it are added."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(x, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000)).alias("_edges"))
    d = df.join(edges, by).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_range", before.alias("_before"))
    return d.join(starts, [*by, "_range"]).withColumn(name, F.col("_before") + midrank(x, [*by, "_range"])).drop("_before", "_range")


def between(x: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are below x."""

    def search(a: int, z: int) -> Column:
        m = (a + z) // 2
        return F.lit(a) if a == z else F.when(x <= edges[m], search(a, m)).otherwise(search(m + 1, z))

    return search(0, len(edges))


def grouped_midranks(df: DataFrame, stored: DataFrame, x: str, groupings: dict[str, list[str]], ranges: int = 256) -> DataFrame:
    """midrank() of x within each grouping, in a column of the grouping's name, for groups of any size. Rows are dealt once by
    ranges of x and neither repeated nor joined with others' rows: ranks are taken within a range and the rows of the
    ranges before it are added. df has the rows of stored, which is read twice to find the ranges and their sizes."""
    edges = stored.agg(F.percentile_approx(x, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000)).first()[0]
    at = between(F.col(x), sorted(set(edges or [])))
    by = sorted({c for g in groupings.values() for c in g})
    sizes = stored.groupBy(at.alias("_at"), *[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_n"))
    starts = []
    for g in groupings.values():
        # Cells of one range stand together, so the frame ends with the range before.
        w = W.partitionBy(*[f"_of_{c}" for c in g]).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
        starts.append(F.coalesce(F.sum("_n").over(w), F.lit(0)))
    sizes = materialize(sizes.select("*", *[s.alias(f"_start_{n}") for n, s in zip(groupings, starts)]).drop("_n"), "range-sizes")
    d = df.withColumn("_range", at).repartition("_range")
    for name, g in groupings.items():
        w = W.partitionBy("_range", *g).orderBy(x)
        d = d.withColumn(name, (F.rank().over(w) + F.count(F.lit(1)).over(w)) / F.lit(2.0))
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    d = d.join(sizes, same).withColumns({n: F.col(n) + F.col(f"_start_{n}") for n in groupings})
    return d.drop("_range", *sizes.columns)


def ordinal(by: list[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def fraction_before(weight: str, by: list[str], *order: Column) -> Column:
    """Share of the weight that stands before the row."""
    w = W.partitionBy(*by)
    return F.coalesce(F.sum(weight).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / F.sum(weight).over(w)


def percentile_within(by: list[str], *order: Column) -> Column:
    """(rank - 1) / (n - 1); 1 for a single row."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return F.when(n == 1, 1.0).otherwise((ordinal(by, *order) - 1) / F.greatest(n - 1, F.lit(1)))


def islands(df: DataFrame, by: list[str], start: str, end: str, key: str, name: str = "island") -> DataFrame:
    """Number the unions of overlapping or touching intervals per group."""
    w = W.partitionBy(*by).orderBy(start, key)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = (F.coalesce(F.col(start) > before, F.lit(True))).cast("long")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(*UP))).drop("_new")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], key: str, name: str = "q") -> DataFrame:
    """Step-up within families; null p-values stay out and get a null."""
    have, lack = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    w = W.partitionBy(*by)
    raw = have.withColumn("_r", F.row_number().over(w.orderBy(p, key))).withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(w) / F.col("_r"))
    q = F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(F.col("_r").desc()).rowsBetween(*UP)))
    return raw.withColumn(name, q).drop("_r", "_raw").unionByName(lack)


def holm(df: DataFrame, p: str, by: list[str], key: str, name: str = "holm") -> DataFrame:
    w = W.partitionBy(*by)
    raw = df.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(p, key))).withColumn("_raw", F.col(p) * (F.count(F.lit(1)).over(w) - F.col("_r") + 1))
    return raw.withColumn(name, F.least(F.lit(1.0), F.max("_raw").over(w.orderBy("_r").rowsBetween(*UP)))).drop("_r", "_raw")


def weighted_quantile(df: DataFrame, x: str, w: str, by: list[str], share: float, name: str) -> DataFrame:
    """The least value at which the cumulative weight reaches its share; ties are summed before the window."""
    d = df.groupBy(*by, x).agg(F.sum(w).alias("_w"))
    win = W.partitionBy(*by)
    return d.withColumn("_c", F.sum("_w").over(win.orderBy(x).rowsBetween(*UP))).withColumn("_t", F.sum("_w").over(win)).where(F.col("_c") >= share * F.col("_t")).groupBy(*by).agg(F.min(x).alias(name))


def median(stored: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Exact medians of groups with names, whatever their size: approximate quantiles on both sides bound the values that are
    counted one by one; all below are one cell. Reads stored twice."""
    bounds = stored.groupBy(*by).agg(F.count(x).alias("_n"), F.percentile_approx(x, F.array(F.lit(0.49), F.lit(0.51)), 10_000).alias("_b"))
    near = stored.join(bounds, by).where(F.col(x) <= F.col("_b")[1])
    cells = near.groupBy(*by, "_n", F.when(F.col(x) >= F.col("_b")[0], F.col(x)).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("_x").rowsBetween(*UP))
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(k), F.col("_x")))
    return cells.withColumn("_upto", upto).groupBy(*by).agg(((at((F.col("_n") - 1) / 2) + at(F.col("_n") / 2)) / 2).alias(name))


def combined(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Simes' and the Cauchy combination of a group's p-values."""
    w = W.partitionBy(*by)
    d = df.where(F.col(p).isNotNull()).withColumn("_q", F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(w.orderBy(p)))
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    return d.groupBy(*by).agg(F.least(F.lit(1.0), F.min("_q")).alias("simes"), (0.5 - F.atan(F.avg(F.tan((0.5 - clipped) * F.pi()))) / F.pi()).alias("acat"))
