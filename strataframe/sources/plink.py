"""Binary genotypes: a .bed file (variant-major) beside its .bim and .fam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the three leading bytes, and copies of the first allele by two-bit code (-1: missing).
MAGIC = b"\x6c\x1b\x01"
COPIES = np.array([2, -1, 1, 0], np.int8)


def read_genotypes(spark: SparkSession, path: str, samples: list[int] | None = None, rows: int = 1024) -> DataFrame:
    """variant_id, chromosome, position, a1, a2, dosage (array<tinyint>, copies of a1; null: missing) of every variant of the sets
    `path` names without ending (a glob names many, one per chromosome); `samples` are places in the .fam to keep, in that order.

    One task reads one set, so a set must be below Spark's limit for a binary file (2 GB), which fails otherwise; decoding
    goes out in batches of `rows` variants. A wrong header or length raises."""
    stem = F.regexp_replace(F.col("path"), r"\.[a-z]+$", "")
    part = lambda end: spark.read.format("binaryFile").load(f"{path}.{end}").select(stem.alias("stem"), F.col("content").alias(end))
    sets = part("bed").join(part("bim"), "stem").join(part("fam"), "stem").select("bed", "bim", "fam")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bed, bim, fam in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(bed.as_buffer(), np.uint8)
                variants = [line.split() for line in bim.as_py().decode().splitlines() if line.strip()]
                n = sum(1 for line in fam.as_py().decode().splitlines() if line.strip())
                stride = -(-n // 4)
                if data[:3].tobytes() != MAGIC or len(data) != 3 + stride * len(variants):
                    raise ValueError("not a variant-major .bed of this .bim and .fam")
                body = data[3:].reshape(len(variants), stride)
                keep = np.arange(n) if samples is None else np.asarray(samples, int)
                for at in range(0, len(variants), rows):
                    chunk, names = body[at : at + rows, keep // 4] >> (2 * (keep % 4)).astype(np.uint8) & 3, variants[at : at + rows]
                    flat = COPIES[chunk].ravel()
                    values = pa.array(flat, pa.int8(), mask=flat < 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * len(keep), pa.int32()), values)
                    text = [pa.array([v[i] for v in names], pa.string()) for i in (1, 0)]
                    yield pa.RecordBatch.from_arrays([*text, pa.array([int(v[3]) for v in names], pa.int64()), *[pa.array([v[i] for v in names], pa.string()) for i in (4, 5)], lists], names=["variant_id", "chromosome", "position", "a1", "a2", "dosage"])

    return sets.mapInArrow(decode, "variant_id string, chromosome string, position long, a1 string, a2 string, dosage array<tinyint>")


def sample_ids(spark: SparkSession, path: str) -> DataFrame:
    """family, sample of each line of a .fam."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(f"{path}.fam").where(F.trim("value") != "").select(F.get(p, 0).alias("family"), F.get(p, 1).alias("sample"))


def allele_frequencies(genotypes: DataFrame) -> DataFrame:
    """variant_id, observed, a1_frequency, maf from the dosages, missing ones left out."""
    seen = F.filter("dosage", lambda g: g.isNotNull())
    d = genotypes.select("variant_id", F.size(seen).cast("long").alias("observed"), F.aggregate(seen, F.lit(0).cast("long"), lambda a, g: a + g).alias("_s"))
    f = F.try_divide(F.col("_s").cast("double"), 2 * F.col("observed"))
    return d.select("variant_id", "observed", f.alias("a1_frequency"), F.least(f, 1 - f).alias("maf"))
