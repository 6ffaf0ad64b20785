"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions, in DataFrame functions only.

Every source gets `min(cap * size, level * weight)` words, with the one level that makes the targets add up to
`ratio` times all words. That level is the fixed point of clamping sources at their cap and sharing the excess by weight.
A source is then taken `floor(target / size)` whole times, and the rest comes from documents in the order of a seeded
hash, up to the document with which the sum is nearest to the target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source or table without
words has target 0; repeated rows are separate documents; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Hash ranges per source. Sums over ranges give each document its running sum without sorting a whole source in one task.
RANGES_HEX = 3


def targets(sizes: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """sizes (source, source_size) -> with weight and target. One row per source, so the windows over all rows are small."""
    total = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    fill = W.orderBy("_full_at", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
        .withColumn("_rank", F.row_number().over(fill))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(total) * F.lit(float(ratio)) - F.col("_before")) / F.col("_open"))
        .withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level")), F.when(F.col("_level") <= F.col("_full_at"), F.col("_rank"))).over(total))
    )
    return s.select("source", "source_size", "weight", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))


def order_hash(doc_id: str, text: str, seed: int) -> Column:
    """The seeded hash by which documents are taken: of the id, or of the text of a document without one."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken = copies * size, and the hash and
    whole repetitions by which it was decided. Texts are read once; only their sizes go on."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order_hash(doc_id, text, seed).alias("hash"))
    d = materialize(d, "sizes").withColumn("_range", F.substring("hash", 1, RANGES_HEX))
    ranges = d.groupBy("source", "_range").agg(F.sum("size").alias("_in_range"))
    goals = targets(ranges.groupBy("source").agg(F.sum("_in_range").alias("source_size")), weights, ratio, cap)
    before = F.coalesce(F.sum("_in_range").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source", "_range", before.alias("_before")).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    ranges = ranges.withColumnsRenamed({"source": "_s", "_range": "_r"})
    run = F.sum("size").over(W.partitionBy("source", "_range").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        d.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_run", F.col("_before") + run)
        .withColumn("whole", whole)
        .withColumn("copies", F.col("whole") + ((F.col("_run") * 2 - F.col("size")) < (F.col("target") - F.col("whole") * F.col("source_size")) * 2).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "hash", "whole")
    )


def repeat(docs: DataFrame, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source", sources_most: int = 100_000, **more: object) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken. What is taken beyond whole repetitions are the documents
    of a source up to one hash, so a row per source says all; it is broadcast if there are at most sources_most sources, and
    joined otherwise. Of rows that share that one hash (they repeat a document), only so many are taken as were decided."""
    plan = materialize(mix(docs, seed=seed, doc_id=doc_id, text=text, source=source, **more).select("source", "hash", "whole", "copies"), "mixed")
    ends = materialize(plan.groupBy("source").agg(F.max("whole").alias("_whole"), F.max(F.when(F.col("copies") > F.col("whole"), F.col("hash"))).alias("_last")).withColumnRenamed("source", "_s"), "ends")
    narrow = F.broadcast if ends.count() <= sources_most else lambda x: x
    same = plan.join(narrow(ends), F.col("source").eqNullSafe(F.col("_s")) & (F.col("hash") == F.col("_last"))).groupBy("source").agg(F.count(F.lit(1)).alias("_ties"), F.count_if(F.col("copies") > F.col("whole")).alias("_taken"))
    ends = materialize(ends.join(same.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_whole", "_last", "_ties", "_taken"), "ends")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_source"), order_hash(doc_id, text, seed).alias("_hash"))
    rows = rows.join(narrow(ends), F.col("_source").eqNullSafe(F.col("_s")))
    doubtful = F.coalesce((F.col("_hash") == F.col("_last")) & (F.col("_taken") < F.col("_ties")), F.lit(False))
    sure = rows.where(~doubtful).select("_row", (F.col("_whole") + F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)).cast("long")).alias("_copies"))
    rank = F.row_number().over(W.partitionBy("_source").orderBy(word_count(F.col(f"_row.`{text}`"))))
    ties = rows.where(doubtful).withColumn("_rank", rank).select("_row", (F.col("_whole") + (F.col("_rank") <= F.col("_taken")).cast("long")).alias("_copies"))
    return sure.unionByName(ties).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
f AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - before) / open AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, rank) FROM l WHERE level <= full_at) * weight, cap)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN (run * 2 - size)::DOUBLE < (target - whole * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
