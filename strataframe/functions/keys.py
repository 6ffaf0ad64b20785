"""Composite identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom(x: Column) -> Column:
    """'1', 'chr1', '1.0', ' X ' -> 'chr1', 'chr1', 'chr1', 'chrX'; blank -> null."""
    body = F.upper(F.regexp_replace(F.regexp_replace(F.trim(x.cast("string")), "(?i)^chr", ""), r"\.0$", ""))
    return F.when(body != "", F.concat(F.lit("chr"), body))


def chrom_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), "^chr", "").try_cast("double").cast("int")


def natural_chrom(x: Column) -> Column:
    """A sort key: numbers first in numeric order, then X, Y, M, then the rest by name."""
    body = F.upper(F.regexp_replace(x.cast("string"), "(?i)^chr", ""))
    n = body.try_cast("int")
    named = F.when(body == "X", 101).when(body == "Y", 102).when(body.isin("M", "MT"), 103)
    return F.struct(F.coalesce(n, named, F.lit(104)).alias("order"), F.when(n.isNull() & named.isNull(), body).alias("name"))


def pair_key(c: Column, pos: Column, ref: Column, alt: Column, gene: Column) -> Column:
    return F.concat_ws(":", chrom(c), pos.cast("long").cast("string"), ref, alt, gene)


def variant_id(c: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom(c), F.lit(":"), pos.cast("long").cast("string"), F.lit("_"), ref, F.lit("_"), alt)


def parsed_variant(x: Column) -> Column:
    """chr1:123_A_G -> struct(chrom, position, ref, alt); null where the form is another."""
    part = lambda k: F.regexp_extract(x, r"^chr([^:]+):(\d+)_([^_]+)_([^_]+)$", k)
    return F.when(part(1) != "", F.struct(F.concat(F.lit("chr"), part(1)).alias("chrom"), part(2).try_cast("long").alias("position"), part(3).alias("ref"), part(4).alias("alt")))


def allele_pair(a: Column, b: Column) -> Column:
    """The same for both orders of the alleles."""
    return F.array_join(F.array_sort(F.array(F.upper(F.trim(a)), F.upper(F.trim(b)))), "/")


def palindromic(a: Column, b: Column) -> Column:
    return F.concat(F.upper(a), F.upper(b)).isin("AT", "TA", "CG", "GC")


def oriented_frequency(freq: Column, counted: Column, ref: Column, alt: Column) -> Column:
    """The frequency of alt, from one that counts either allele."""
    return F.when(counted == alt, freq).when(counted == ref, 1 - freq)


def known(x: Column) -> Column:
    """Null for blank text and the text 'nan'."""
    return F.when(~F.lower(F.trim(x.cast("string"))).isin("", "nan"), x)
