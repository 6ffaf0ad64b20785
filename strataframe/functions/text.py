"""Text and row transforms as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unversioned(x: Column) -> Column:
    """'ENSG01.3' -> 'ENSG01'."""
    return F.substring_index(x, ".", 1)


def bare_id(x: Column) -> Column:
    """Without letters and underscores in front."""
    return F.regexp_replace(x, "^[A-Za-z_]+", "")


def slug(x: Column) -> Column:
    """A name for files."""
    for old, new in (("/", "_"), (" ", "_"), (">", "gt"), ("<", "lt")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def listed(x: Column, item: str) -> Column:
    """Whether a comma-separated list has the item itself."""
    return F.array_contains(F.split(x, ","), item)


def snv(ref: Column, alt: Column) -> Column:
    """Two different single bases."""
    a, b = F.upper(F.trim(ref)), F.upper(F.trim(alt))
    return a.rlike("^[ACGT]$") & b.rlike("^[ACGT]$") & (a != b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def split_variant(x: Column) -> Column:
    """'c:p_r_a' and 'c:p:r>a' as an array of the four parts."""
    return F.split(x, "[:_>]")


def number_list(x: Column, prefix: str) -> Column:
    """'10+2+10' -> prefix and '2+10': distinct, in numeric order."""
    numbers = F.array_sort(F.transform(F.array_distinct(F.split(x, r"\+")), lambda v: v.cast("int")))
    return F.concat(F.lit(prefix), F.array_join(F.transform(numbers, lambda v: v.cast("string")), "+"))


def first_rule(x: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose text occurs, in any case."""
    out = None
    for needle, label in rules:
        hit = F.lower(x).contains(needle.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def safe_exp(x: Column, most: float = 700.0) -> Column:
    """exp, infinite and zero beyond what a double holds."""
    return F.when(x > most, float("inf")).when(x < -most, 0.0).otherwise(F.exp(x))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """To the canonical vocabulary; a column that has both names takes the first that is known."""
    out = df
    for old, new in names.items():
        if old in out.columns and new in out.columns:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
        elif old in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def preferred(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns of order that exist."""
    return df.select(*[c for c in order if c in df.columns])


def merged_suffixes(df: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Columns a_x and a_y become a, the first that is known."""
    a, b = suffixes
    both = [c[: -len(a)] for c in df.columns if c.endswith(a) and c[: -len(a)] + b in df.columns]
    for c in both:
        df = df.withColumn(c, F.coalesce(F.col(c + a), F.col(c + b))).drop(c + a, c + b)
    return df


def without_empty(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])
