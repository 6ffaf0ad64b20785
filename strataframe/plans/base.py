"""The tables of a scored benchmark, cast onto the driver's star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..operators.select import keep_first


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def mixed(a: int, b: int, c: int) -> Column:
    """A number in [0, 1) from the row's keys; plain arithmetic, so that SQL can follow it."""
    return ((F.col("l_orderkey") * a + F.col("l_partkey") * b + F.col("l_linenumber") * c + F.col("l_suppkey")) % 10007) / 10007.0


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair: group, gene, position, distance, frequency, evidence, two scores."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    # A pair key of four parts stands for its numbers. Dealt by the order's alone, rows move once for both the window and the
    # join, and filters on what the numbers fix come before that. Keys with a null have fewer parts, so the two never mix.
    numbers, order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_discount"]
    key, lacks = F.concat_ws(":", *numbers), F.greatest(*[F.col(c).isNull() for c in numbers])
    at = F.col("l_orderkey") == F.col("o_orderkey")
    d = keep_first(l.where(~lacks).repartition("l_orderkey"), numbers, *order).join(o, at).withColumn("pair_key", key)
    odd = keep_first(l.where(lacks).withColumn("pair_key", key), ["pair_key"], *order).join(o, at)
    d = d.unionByName(odd)
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    maf = F.col("l_quantity") / 100
    pip = F.pow(mixed(7919, 104729, 1299709), F.lit(3.0))
    out = d.select(
        F.when(F.col("l_returnflag") == "A", "AA").when(F.col("l_returnflag") == "N", "CH").otherwise("NHW").alias("ancestry"), "pair_key",
        (F.col("l_partkey") % 211).alias("gene"), (F.col("l_suppkey") % 22 + 1).cast("long").alias("chrom"), (F.col("l_partkey") * 1000 + F.col("l_orderkey") % 1000).alias("position"),
        (days % 120 * 400).cast("long").alias("distance"), maf.alias("maf"), pip.alias("pip"), (F.col("l_linenumber") % 4).cast("long").alias("cs"),
        (mixed(31, 37, 41) - 0.5 + pip / 4).alias("borzoi"), (mixed(43, 47, 53) - 0.5 + pip / 2).alias("alphagenome"), mixed(59, 61, 67).alias("pvalue"), (1 + F.col("l_linenumber") / 2).cast("double").alias("weight"),
    )
    return out.withColumns({"tss_bin": bins.tss_bin(F.col("distance")), "maf_bin": bins.maf_bin(F.col("maf")), "pip_class": bins.pip_class(F.col("pip"))})


#: The same in SQL, for the oracle.
SCORED = """
WITH ranked AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pair_key FROM lineitem),
firsts AS (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_discount) AS rn FROM ranked),
raw AS (SELECT *, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS days,
  pow(((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709 + l_suppkey) % 10007) / 10007.0::DOUBLE, 3.0::DOUBLE) AS pip_
  FROM firsts JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1),
vals AS (SELECT CASE l_returnflag WHEN 'A' THEN 'AA' WHEN 'N' THEN 'CH' ELSE 'NHW' END AS ancestry, pair_key, (l_partkey % 211)::BIGINT AS gene, (l_suppkey % 22 + 1)::BIGINT AS chrom,
  (l_partkey * 1000 + l_orderkey % 1000)::BIGINT AS position, (days % 120 * 400)::BIGINT AS distance, l_quantity / 100 AS maf, pip_ AS pip, (l_linenumber % 4)::BIGINT AS cs,
  ((l_orderkey * 31 + l_partkey * 37 + l_linenumber * 41 + l_suppkey) % 10007) / 10007.0::DOUBLE - 0.5::DOUBLE + pip_ / 4 AS borzoi,
  ((l_orderkey * 43 + l_partkey * 47 + l_linenumber * 53 + l_suppkey) % 10007) / 10007.0::DOUBLE - 0.5::DOUBLE + pip_ / 2 AS alphagenome,
  ((l_orderkey * 59 + l_partkey * 61 + l_linenumber * 67 + l_suppkey) % 10007) / 10007.0::DOUBLE AS pvalue, (1 + l_linenumber / 2.0::DOUBLE)::DOUBLE AS weight FROM raw),
scored AS (SELECT *, CASE WHEN abs(distance) <= 3000 THEN '0-3kb' WHEN abs(distance) <= 12000 THEN '3-12kb' WHEN abs(distance) <= 35000 THEN '12-35kb' ELSE '>35kb' END AS tss_bin,
  CASE WHEN maf >= 0 AND maf < 0.05 THEN '<0.05' WHEN maf >= 0.05 AND maf < 0.2 THEN '0.05-0.2' WHEN maf >= 0.2 AND maf <= 0.5 THEN '>=0.2' END AS maf_bin,
  CASE WHEN pip >= 0.5 THEN 'positive' WHEN pip < 0.01 THEN 'low' ELSE 'intermediate' END AS pip_class FROM vals)
"""
