"""Readers and writers of delimited, whitespace, BED and VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import natural_chrom


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t", na: str = "NA", provenance: bool = False) -> DataFrame:
    """Text with a header; files may lack columns or order them otherwise, since names bind. gz files are not splittable: convert once to Parquet."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue=na, enforceSchema=False, inferSchema=False)
    import pyspark.sql.types as T

    want = T._parse_datatype_string(schema)
    out = df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields], *([F.col("_metadata.file_path").alias("source_file")] if provenance else []))
    return out


def sniff(spark: SparkSession, path: str, candidates: str = "\t,; |") -> str:
    line = spark.read.text(path).limit(1).first()
    return max(candidates, key=lambda c: line.value.count(c)) if line else "\t"


def read_whitespace(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """Columns by position between runs of white space, as text."""
    parts = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
    return df.where(F.col(names[0]) != names[0]) if header else df


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name; comments, short lines and lines with odd coordinates are skipped, equal lines are one."""
    p = F.split("value", "\t")
    df = spark.read.text(path).where(~F.col("value").startswith("#")).distinct()
    return df.select(F.get(p, 0).alias("chrom"), F.get(p, 1).try_cast("long").alias("start"), F.get(p, 2).try_cast("long").alias("end"), F.get(p, 3).alias("name")).where("start is not null and end is not null")


def read_keep_list(spark: SparkSession, path: str) -> DataFrame:
    """The second field of each line, else the first."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.coalesce(F.get(p, 1), F.get(p, 0)).alias("id"))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", na: str = "NA", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").options(sep=sep, header=True, nullValue=na, compression="gzip")
    (w.partitionBy(*by) if by else w).csv(path)


def vcf_lines(df: DataFrame) -> DataFrame:
    """Distinct variants (chrom, position, ref, alt) as VCF 4.2 lines in natural order, after the header."""
    head = df.sparkSession.createDataFrame([(0, "##fileformat=VCFv4.2"), (1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "i int, value string")
    name = F.concat_ws("_", "chrom", "position", "ref", "alt")
    body = df.select("chrom", "position", "ref", "alt").distinct().select(F.lit(2).alias("i"), F.concat_ws("\t", "chrom", "position", name, "ref", "alt", F.lit("."), F.lit("."), F.lit(".")).alias("value"), natural_chrom(F.col("chrom")).alias("c"), "position", "ref", "alt")
    return head.withColumns({"c": F.lit(None), "position": F.lit(None), "ref": F.lit(None), "alt": F.lit(None)}).unionByName(body).orderBy("i", "c", "position", "ref", "alt").select("value")


def bed_lines(df: DataFrame) -> DataFrame:
    """(chrom, position, name) as sorted half-open lines from zero."""
    return df.select("chrom", "position", "name").distinct().orderBy(natural_chrom(F.col("chrom")), "position", "name").select(F.concat_ws("\t", "chrom", (F.col("position") - 1).cast("long"), "position", "name").alias("value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
