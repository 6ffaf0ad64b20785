"""Enrichment of matched sets: one positive and some controls each. Sets are summed once; resampling weighs the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hashing import stable_u32, uniform
from .auroc import multiplicities


def matched_sets(df: DataFrame, strata: list[str], key: str, positive: Column, k: int, seed: int = 5) -> DataFrame:
    """df with `set`: positives and controls are numbered by a hash in their stratum, and each positive takes the next k
    controls. Positives without a control have a set of their own."""
    d = df.withColumn("_p", positive)
    order = W.partitionBy(*strata, "_p").orderBy(stable_u32(F.concat_ws("|", F.lit(seed), F.col(key))), key)
    d = d.withColumn("_i", F.row_number().over(order)).withColumn("set", F.when(F.col("_p"), F.col("_i")).otherwise(F.ceil(F.col("_i") / k)).cast("long"))
    most = d.where("_p").groupBy(*strata).agg(F.max("_i").alias("_most"))
    return d.join(most, strata).where(F.col("set") <= F.col("_most")).drop("_i", "_most").withColumnRenamed("_p", "positive")


def set_sums(sets: DataFrame, by: list[str], cluster: str, hit: Column) -> DataFrame:
    """Per set the positive's hit, the controls' hits and their number, and the positive's cluster."""
    h = hit.cast("double")
    return sets.groupBy(*by, "set").agg(F.max(F.when(F.col("positive"), h)).alias("hit"), F.coalesce(F.sum(F.when(~F.col("positive"), h)), F.lit(0.0)).alias("hits"), F.count_if(~F.col("positive")).cast("double").alias("controls"), F.max(F.when(F.col("positive"), F.col(cluster))).alias(cluster)).where("hit is not null")


#: Parts of the odds ratio of a set: positives hit against controls not, and the other way round.
NUM, DEN = "hit * (controls - hits) / (controls + 1)", "(1 - hit) * hits / (controls + 1)"


def log_odds(num: Column, den: Column, most: float = 1000.0) -> Column:
    """Log odds ratio of summed parts, at its bound where one side is empty; null where both are."""
    return F.when((num > 0) & (den > 0), F.greatest(F.lit(-most), F.least(F.lit(most), F.log(num) - F.log(den)))).when(num > 0, most).when(den > 0, -most)


def replicates(sums: DataFrame, by: list[str], cluster: str, n: int, seed: int = 42) -> DataFrame:
    """(by, replicate, log_or) over resampled clusters, from sums per cluster."""
    parts = sums.groupBy(*by, cluster).agg(F.sum(F.expr(NUM)).alias("num"), F.sum(F.expr(DEN)).alias("den"))
    m = multiplicities(parts, cluster, by, n, seed)
    each = parts.join(m, [*by, cluster]).groupBy(*by, "replicate").agg(F.sum(F.col("m") * F.col("num")).alias("num"), F.sum(F.col("m") * F.col("den")).alias("den"))
    # Rounded, so that a ratio of one is on neither side of it.
    return each.select(*by, "replicate", F.round(log_odds(F.col("num"), F.col("den")), 9).alias("log_or"))


def interval(values: DataFrame, by: list[str], x: str) -> DataFrame:
    return values.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high"), stats.sign_p(F.col(x)).alias("p"))


def enrichment(sums: DataFrame, by: list[str], cluster: str, n: int, seed: int = 42) -> DataFrame:
    """Per group: sets, hits, informative sets, log odds ratio with a bootstrap interval and p; a table in which no set tells
    anything is degenerate, with p = 1 and no ratio."""
    told = (F.col("hit") + F.col("hits") > 0) & (F.col("hit") + F.col("hits") < F.col("controls") + 1) & (F.col("controls") > 0)
    point = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("sets"), F.sum("hit").alias("hits_positive"), F.sum("hits").alias("hits_controls"), F.count_if(told).alias("informative"), F.sum(F.expr(NUM)).alias("_num"), F.sum(F.expr(DEN)).alias("_den"))
    d = point.join(interval(replicates(sums, by, cluster, n, seed), by, "log_or"), by, "left")
    empty = F.col("informative") == 0
    return d.select(*by, "sets", "hits_positive", "hits_controls", "informative", F.when(~empty, log_odds(F.col("_num"), F.col("_den"))).alias("log_or"), "low", "high", F.when(empty, 1.0).otherwise(F.col("p")).alias("p"))


def permuted_sets(sums: DataFrame, keys: list[str], seed: int = 9) -> DataFrame:
    """Set sums with the label permuted: one member is drawn by a hash of keys to be the positive, so it is hit with the set's
    share of hits."""
    total = F.col("hit") + F.col("hits")
    u = uniform(F.concat_ws("|", F.lit(seed), *keys))
    return sums.withColumn("_t", total).withColumn("hit", (u < total / (F.col("controls") + 1)).cast("double")).withColumn("hits", F.col("_t") - F.col("hit")).drop("_t")
