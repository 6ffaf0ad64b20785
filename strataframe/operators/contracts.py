"""Data contracts as one-row checks that union into a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """check, status, details: rows for which bad is true."""
    return df.agg(F.count_if(bad).alias("_n")).select(F.lit(name).alias("check"), F.when(F.col("_n") == 0, "pass").otherwise("fail").alias("status"), F.col("_n").alias("details"))


def unique(df: DataFrame, name: str, *key: str) -> DataFrame:
    return check(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")), name, F.col("_c") > 1)


def complete(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return check(df, name, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def conflicts(df: DataFrame, key: list[str], value: str, spread: float = 1e-5) -> DataFrame:
    """Keys whose values spread too far."""
    return df.groupBy(*key).agg((F.max(value) - F.min(value)).alias("spread"), F.count(F.lit(1)).alias("n")).where(F.col("spread") > spread)


def ledger(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(ledger_rows: DataFrame) -> None:
    failed = [r["check"] for r in ledger_rows.where("status = 'fail'").collect()]
    if failed:
        raise ValueError("contracts broken: " + ", ".join(failed))


def required_columns(df: DataFrame, *columns: str) -> None:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError("columns missing: " + ", ".join(lacking))


def homogeneous(df: DataFrame, name: str, column: str, allowed: list) -> DataFrame:
    """Only these values occur."""
    return check(df, name, F.col(column).isNull() | ~F.col(column).isin(allowed))


def cardinality(df: DataFrame, name: str, expected: int) -> DataFrame:
    """Details: rows beyond or short of the expected number."""
    return df.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(name).alias("check"), F.when(F.col("_n") == expected, "pass").otherwise("fail").alias("status"), F.abs(F.col("_n") - expected).alias("details"))


def partition(whole: DataFrame, parts: DataFrame, name: str, key: str) -> DataFrame:
    """Every key of the whole is in the parts once, and no other."""
    n = whole.select(F.col(key).alias("_k")).join(parts.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c")), "_k", "full").select(F.coalesce("_c", F.lit(0)).alias("_c"))
    outside = parts.join(whole, key, "left_anti").select(F.lit(2).alias("_c"))
    return check(n.unionByName(outside), name, F.col("_c") != 1)


def within(df: DataFrame, name: str, column: str, most: float) -> DataFrame:
    """A gate: no value beyond the bound in either direction."""
    return check(df, name, F.abs(F.col(column)) > most)


def agreement(a: DataFrame, b: DataFrame, name: str, key: str, column: str) -> DataFrame:
    """Keys of both whose values differ."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    return check(both, name, ~F.col("_a").eqNullSafe(F.col("_b")))
