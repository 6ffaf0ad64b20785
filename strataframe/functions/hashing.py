"""Randomness keyed by SHA-256: the same draws under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_u64(key: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_u32(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """In (0, 1)."""
    return (stable_u64(key).cast("double") + 1.0) / F.lit(float(2**64) + 1.0)


def draw(key: Column, n: Column) -> Column:
    """An index from 1 to n."""
    return (stable_u32(key) % n + 1).cast("long")


def exponential_race(key: Column, weight: Column) -> Column:
    """The k least priorities are a weighted sample of k without replacement."""
    return -F.log(F.greatest(uniform(key), F.lit(1e-300))) / weight
