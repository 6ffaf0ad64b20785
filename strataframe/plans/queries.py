"""Queries over the driver's tables, one or more per group of the operator inventory, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bins, hashing, keys, stats
from ..operators import auroc, contracts, cubes, glm, intervals, linkage, matching, ranks, regress, select
from ..storage import materialize
from .base import SCORED, scored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True) -> Callable:
    """Register a query under its function's name, with its SQL (after the common tables, unless base is false)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (SCORED if base else "") + sql
        return f

    return add


def r(c: str | F.Column, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


# Correlation, counts, distributions -------------------------------------------------------------------------------


@query("""
, g AS (SELECT unnest(['All', ancestry]) AS g1, tss_bin, borzoi AS x, alphagenome AS y FROM scored),
h AS (SELECT g1, unnest(['All', tss_bin]) AS g2, x, y FROM g),
k AS (SELECT *, rank() OVER (PARTITION BY g1, g2 ORDER BY x) + (count(*) OVER (PARTITION BY g1, g2, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY g1, g2 ORDER BY y) + (count(*) OVER (PARTITION BY g1, g2, y) - 1) / 2.0::DOUBLE AS ry FROM h),
a AS (SELECT g1, g2, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, avg((sign(x) = sign(y))::INT::DOUBLE) AS c FROM k GROUP BY g1, g2 HAVING count(*) >= 10)
SELECT g1, g2, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tanh(atanh(spearman) - 1.959963984540054 / sqrt(n - 3)), 6) AS rho_low, round(tanh(atanh(spearman) + 1.959963984540054 / sqrt(n - 3)), 6) AS rho_high,
 round(c, 6) AS concordance, round(greatest(0, c - 1.959963984540054 * sqrt(c * (1 - c) / n)), 6) AS conc_low, round(least(1, c + 1.959963984540054 * sqrt(c * (1 - c) / n)), 6) AS conc_high FROM a
""")
def concordance_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cubes.concordance(scored(spark, sf_dir), "ancestry", "tss_bin", "borzoi", "alphagenome")
    return d.select("g1", "g2", "n", *map(r, ("pearson", "spearman", "rho_low", "rho_high", "concordance", "conc_low", "conc_high")))


@query("SELECT ancestry, pip_class, count(*) AS n, count(DISTINCT gene) AS genes, round(max(pip), 6) AS top, round(median(maf), 6) AS median_maf, round(avg((cs = 0)::INT::DOUBLE), 6) AS outside, round(sum(weight), 6) AS weight FROM scored GROUP BY 1, 2")
def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("ancestry", "pip_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gene").alias("genes"), r(F.max("pip"), "top"), r(F.percentile("maf", F.lit(0.5)), "median_maf"), r(F.avg((F.col("cs") == 0).cast("double")), "outside"), r(F.sum("weight"), "weight"))


@query("""
, t AS (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS threshold)
SELECT ancestry, threshold, count(*) AS n, round(quantile_cont(maf, 0.25), 6) AS q25, round(quantile_cont(maf, 0.5), 6) AS q50, round(quantile_cont(maf, 0.75), 6) AS q75, round(avg(maf), 6) AS mean, round(stddev_samp(maf), 6) AS sd, round(100 * avg((maf < 0.05)::INT::DOUBLE), 6) AS rare_percent
FROM scored JOIN t ON pip >= threshold GROUP BY 1, 2
""")
def maf_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter grid fans rows out to the thresholds they reach."""
    d = scored(spark, sf_dir).select("ancestry", "maf", F.explode(F.filter(F.array(F.lit(0.5), F.lit(0.9)), lambda t: F.col("pip") >= t)).alias("threshold"))
    q = lambda p: r(F.percentile("maf", F.lit(p)), f"q{int(p * 100)}")
    return d.groupBy("ancestry", "threshold").agg(F.count(F.lit(1)).alias("n"), q(0.25), q(0.5), q(0.75), r(F.avg("maf"), "mean"), r(F.stddev_samp("maf"), "sd"), r(100 * F.avg((F.col("maf") < 0.05).cast("double")), "rare_percent"))


@query("""
SELECT ancestry, count(*) AS before, count(*) FILTER (kept) AS after, count(*) FILTER (NOT kept AND pip_class = 'low') AS low_dropped FROM
(SELECT *, CASE pip_class WHEN 'positive' THEN true WHEN 'low' THEN cs = 0 ELSE cs > 0 END AS kept FROM scored) GROUP BY 1
""")
def pool_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = bins.in_pool(F.col("pip"), F.col("cs"))
    return scored(spark, sf_dir).groupBy("ancestry").agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.count_if(~kept & (F.col("pip_class") == "low")).alias("low_dropped"))


@query("""
SELECT ancestry, count(*) FILTER (a) AS far, count(*) FILTER (b) AS rare, count(*) FILTER (c) AS weak, count(*) FILTER (a OR b OR c) AS excluded FROM
(SELECT ancestry, distance > 35000 AS a, maf < 0.05 AS b, pvalue > 0.5 AS c FROM scored) GROUP BY 1
""")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("distance") > 35000, F.col("maf") < 0.05, F.col("pvalue") > 0.5
    return scored(spark, sf_dir).groupBy("ancestry").agg(F.count_if(a).alias("far"), F.count_if(b).alias("rare"), F.count_if(c).alias("weak"), F.count_if(a | b | c).alias("excluded"))


@query("SELECT least(9, floor(maf * 20))::BIGINT AS bin, count(*) AS n FROM scored GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("maf") * 20)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, sha256(string_agg(event_type, chr(10) ORDER BY event_type)) AS signature FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1", False)
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_join(s, ",").alias("types"), F.sha2(F.array_join(s, "\n"), 256).alias("signature"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS top FROM events GROUP BY 1", False)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events", "event_type", "props").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query("SELECT gene, bit_or((1 << (CASE ancestry WHEN 'AA' THEN 0 WHEN 'CH' THEN 1 ELSE 2 END)))::BIGINT AS flags, count(DISTINCT ancestry) = 3 AS shared, min(distance) AS nearest, bool_or(pip >= 0.9) AS strong FROM scored GROUP BY 1")
def flag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.when(F.col("ancestry") == "AA", 1).when(F.col("ancestry") == "CH", 2).otherwise(4).cast("long")
    return scored(spark, sf_dir).groupBy("gene").agg(F.bit_or(bit).alias("flags"), (F.countDistinct("ancestry") == 3).alias("shared"), F.min("distance").alias("nearest"), F.bool_or(F.col("pip") >= 0.9).alias("strong"))


@query("""
, s AS (SELECT DISTINCT ancestry, gene FROM scored WHERE pip >= 0.9)
SELECT a.ancestry AS a, b.ancestry AS b, count(*) AS both, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.gene = b.gene AND a.ancestry < b.ancestry
JOIN (SELECT ancestry, count(*) AS n FROM s GROUP BY 1) x ON x.ancestry = a.ancestry JOIN (SELECT ancestry, count(*) AS n FROM s GROUP BY 1) y ON y.ancestry = b.ancestry GROUP BY 1, 2
""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of sets in pairs, from one row per element: each element fans out to the pairs of its sets."""
    s = scored(spark, sf_dir).where("pip >= 0.9").select("ancestry", "gene").distinct()
    n = s.groupBy("ancestry").agg(F.count(F.lit(1)).alias("n"))
    sets = s.groupBy("gene").agg(F.array_sort(F.collect_set("ancestry")).alias("g"))
    pairs = sets.select(F.explode(F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("both"))
    d = pairs.join(n.select(F.col("ancestry").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("ancestry").alias("b"), F.col("n").alias("nb")), "b")
    return d.select("a", "b", "both", r(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), "jaccard"))


# Joins, reshape, keys ---------------------------------------------------------------------------------------------


@query("""
, g AS (SELECT gene, max(position) AS tss FROM scored GROUP BY 1)
SELECT pair_key, abs(position - tss)::BIGINT AS gap, CASE WHEN abs(position - tss) <= 3000 THEN '0-3kb' WHEN abs(position - tss) <= 12000 THEN '3-12kb' WHEN abs(position - tss) <= 35000 THEN '12-35kb' ELSE '>35kb' END AS bin, round(log10(greatest(abs(position - tss), 1)), 6) AS log_gap FROM scored JOIN g USING (gene)
""")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    genes = d.groupBy("gene").agg(F.max("position").alias("tss"))
    gap = F.abs(F.col("position") - F.col("tss"))
    return d.join(genes, "gene", "left").select("pair_key", gap.alias("gap"), bins.tss_bin(gap).alias("bin"), r(bins.log_distance(gap), "log_gap"))


@query("SELECT p_brand, count(*) AS parts, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)) AS with_large, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)) AS without FROM part GROUP BY 1", False)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    large = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    both = p.join(large, "p_partkey", "left_semi").select("p_brand", F.lit(1).alias("x")).unionByName(p.join(large, "p_partkey", "left_anti").select("p_brand", F.lit(0).alias("x")))
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("x") == 1).alias("with_large"), F.count_if(F.col("x") == 0).alias("without"))


@query("""
, e AS (SELECT ancestry, tss_bin, count(*) AS n FROM scored WHERE pip >= 0.5 GROUP BY 1, 2), f AS (SELECT ancestry, tss_bin, count(*) AS n FROM scored WHERE pip < 0.0001 GROUP BY 1, 2)
SELECT coalesce(e.ancestry, f.ancestry) AS ancestry, coalesce(e.tss_bin, f.tss_bin) AS tss_bin, coalesce(e.n, -1) AS expected, coalesce(f.n, -1) AS observed FROM e FULL JOIN f ON e.ancestry = f.ancestry AND e.tss_bin = f.tss_bin
""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    n = lambda c, name: d.where(c).groupBy("ancestry", "tss_bin").agg(F.count(F.lit(1)).alias(name))
    return n("pip >= 0.5", "expected").join(n("pip < 0.0001", "observed"), ["ancestry", "tss_bin"], "full").fillna(-1, ["expected", "observed"])


@query("SELECT pair_key, round(borzoi, 6) AS borzoi, round(alphagenome, 6) AS alphagenome FROM scored WHERE borzoi > 0 OR alphagenome > 0".replace("round(borzoi, 6)", "CASE WHEN borzoi > 0 THEN round(borzoi, 6) END").replace("round(alphagenome, 6)", "CASE WHEN alphagenome > 0 THEN round(alphagenome, 6) END"))
def unpivot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide scores to long by tool, without the missing ones, and back."""
    long = scored(spark, sf_dir).unpivot(["pair_key"], ["borzoi", "alphagenome"], "tool", "score").where("score > 0")
    return long.groupBy("pair_key").pivot("tool", ["borzoi", "alphagenome"]).agg(F.first("score")).select("pair_key", r("borzoi"), r("alphagenome"))


@query("""
SELECT l_linenumber::BIGINT AS line, 'chr' || l_linenumber || ':' || l_partkey || '_A_' || (CASE WHEN l_suppkey % 2 = 0 THEN 'T' ELSE 'G' END) AS variant, 'A/' || (CASE WHEN l_suppkey % 2 = 0 THEN 'T' ELSE 'G' END) AS alleles, l_suppkey % 2 = 0 AS palindromic, l_partkey AS parsed, count(*) AS n FROM lineitem GROUP BY ALL
""", False)
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey")
    alt = F.when(F.col("l_suppkey") % 2 == 0, "T").otherwise("G")
    v = d.select(F.col("l_linenumber").cast("long").alias("line"), keys.variant_id(F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")), F.col("l_partkey"), F.lit("A"), alt).alias("variant"), keys.allele_pair(alt, F.lit(" a")).alias("alleles"), keys.palindromic(F.lit("A"), alt).alias("palindromic"))
    return v.groupBy("line", "variant", "alleles", "palindromic", keys.parsed_variant(F.col("variant"))["position"].alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("""
, i AS (SELECT o_orderkey, (o_custkey % 22 + 1)::BIGINT AS chrom, (o_orderkey % 2000) * 1000 AS s, (o_orderkey % 2000) * 1000 + 1 + (o_custkey % 5) * 700 AS e, o_orderpriority AS category FROM orders)
SELECT chrom, category, count(*) AS hits, count(DISTINCT pair_key) AS points FROM scored JOIN i USING (chrom) WHERE position >= s AND position < e GROUP BY 1, 2
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select((F.col("o_custkey") % 22 + 1).cast("long").alias("chrom"), (F.col("o_orderkey") % 2000 * 1000).alias("s"), (F.col("o_orderkey") % 2000 * 1000 + 1 + F.col("o_custkey") % 5 * 700).alias("e"), F.col("o_orderpriority").alias("category"))
    hits = intervals.point_in_interval(scored(spark, sf_dir).select("pair_key", "chrom", "position"), i, "chrom", "position", "s", "e", 2000)
    return hits.groupBy("chrom", "category").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("pair_key").alias("points"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS click_raw, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase_raw, (count(*) FILTER (event_type = 'click') > 0)::INT AS click_binary, (count(*) FILTER (event_type = 'purchase') > 0)::INT AS purchase_binary, (count(*) FILTER (event_type IN ('click', 'purchase')) > 0)::INT AS \"any\" FROM events GROUP BY 1", False)
def dense_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type")
    return intervals.category_counts(e, e, "user_id", "event_type", ["click", "purchase"])


# Selection --------------------------------------------------------------------------------------------------------

U64 = "('0x' || substr(sha256({}), 1, 16))::UBIGINT"


@query(f", p AS (SELECT *, row_number() OVER (PARTITION BY ancestry, tss_bin ORDER BY {U64.format(chr(39) + 'nominal|7|' + chr(39) + ' || pair_key')}, pair_key) AS rn FROM scored) SELECT ancestry, tss_bin, pair_key FROM p WHERE rn <= 25")
def hash_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "tss_bin", "pair_key")
    return select.top_k(d, ["ancestry", "tss_bin"], 25, hashing.stable_u64(F.concat(F.lit("nominal|7|"), "pair_key")), "pair_key")


@query(f", p AS (SELECT *, -ln(greatest(({U64.format(chr(39) + 'background|7|' + chr(39) + ' || pair_key')}::DOUBLE + 1.0::DOUBLE) / (18446744073709551616.0::DOUBLE + 1.0::DOUBLE), 1e-300)) / (CASE WHEN cs = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS race FROM scored), q AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY race, pair_key) AS rn FROM p) SELECT ancestry, pair_key, cs FROM q WHERE rn <= 50")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "pair_key", "cs")
    return select.top_k(d, ["ancestry"], 50, hashing.exponential_race(F.concat(F.lit("background|7|"), "pair_key"), F.when(F.col("cs") == 0, 2.0).otherwise(1.0)), "pair_key")


@query(f"""
, s AS (SELECT tss_bin, maf_bin, count(*) AS n FROM scored GROUP BY 1, 2), q AS (SELECT *, greatest(1, round_even(500 * n / (SELECT sum(n) FROM s)::DOUBLE, 0)) AS take FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY tss_bin, maf_bin ORDER BY {U64.format('pair_key')}, pair_key) AS rn FROM scored)
SELECT p.tss_bin, p.maf_bin, p.pair_key FROM p JOIN q ON p.tss_bin = q.tss_bin AND p.maf_bin = q.maf_bin WHERE rn <= take
""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("tss_bin", "maf_bin", "pair_key")
    return select.proportional(d, ["tss_bin", "maf_bin"], 500, hashing.stable_u64(F.col("pair_key")), "pair_key")


@query(f", p AS (SELECT *, row_number() OVER (PARTITION BY ancestry, pip_class ORDER BY cs = 3 DESC, {U64.format('pair_key')}, pair_key) AS rn FROM scored) SELECT ancestry, pip_class, pair_key, cs = 3 AS reused FROM p WHERE rn <= 40")
def tiered_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "pip_class", "pair_key", (F.col("cs") == 3).alias("reused"))
    return select.tiered(d, ["ancestry", "pip_class"], 40, F.col("reused"), hashing.stable_u64(F.col("pair_key")), "pair_key")


@query(", p AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY pip DESC, weight DESC, pair_key) AS rn FROM scored) SELECT gene, pair_key, round(pip, 6) AS pip FROM p WHERE rn = 1")
def best_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.keep_first(scored(spark, sf_dir), ["gene"], F.col("pip").desc(), F.col("weight").desc(), "pair_key").select("gene", "pair_key", r("pip"))


@query("SELECT *, ((row_number() OVER (PARTITION BY chrom ORDER BY position, pair_key) - 1) // 500)::BIGINT AS chunk FROM (SELECT chrom, position, pair_key FROM scored)")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("chrom", "position", "pair_key")
    return d.withColumn("chunk", F.floor((ranks.ordinal(["chrom"], F.col("position"), F.col("pair_key")) - 1) / 500).cast("long"))


# Ranks and multiple testing ---------------------------------------------------------------------------------------


@query("""
SELECT pair_key, row_number() OVER w AS rank, round(coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER (PARTITION BY gene), 6) AS tail,
round(CASE WHEN count(*) OVER (PARTITION BY gene) = 1 THEN 1 ELSE (row_number() OVER (PARTITION BY gene ORDER BY abs(borzoi), pair_key) - 1) / (count(*) OVER (PARTITION BY gene) - 1)::DOUBLE END, 6) AS percentile
FROM scored WINDOW w AS (PARTITION BY gene ORDER BY abs(borzoi) DESC, pair_key)
""")
def gene_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a, k = scored(spark, sf_dir), F.abs("borzoi"), F.col("pair_key")
    return d.select("pair_key", ranks.ordinal(["gene"], a.desc(), k).cast("long").alias("rank"), r(ranks.fraction_before("weight", ["gene"], a.desc(), k), "tail"), r(ranks.percentile_within(["gene"], a, k), "percentile"))


@query("""
, g AS (SELECT chrom, gene, min(position) - 10000 AS s, min(position) + 10000 AS e FROM scored GROUP BY 1, 2),
m AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT *, sum(coalesce(s > before, true)::INT) OVER (PARTITION BY chrom ORDER BY s, gene ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT chrom, island::BIGINT AS island, count(*) AS genes, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM i GROUP BY 1, 2
""")
def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupBy("chrom", "gene").agg((F.min("position") - 10000).alias("s"), (F.min("position") + 10000).alias("e"))
    return ranks.islands(g, ["chrom"], "s", "e", "gene").groupBy("chrom", "island").agg(F.count(F.lit(1)).alias("genes"), F.min("s").alias("s"), F.max("e").alias("e"))


@query("""
, f AS (SELECT ancestry, gene, min(pvalue) AS p FROM scored GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY p, gene) AS rk, count(*) OVER (PARTITION BY ancestry) AS n FROM f)
SELECT ancestry, gene, round(least(1, min(p * n / rk) OVER (PARTITION BY ancestry ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q, round(least(1, max(p * (n - rk + 1)) OVER (PARTITION BY ancestry ORDER BY rk ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM k
""")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scored(spark, sf_dir).groupBy("ancestry", "gene").agg(F.min("pvalue").alias("p"))
    d = ranks.holm(ranks.benjamini_hochberg(f, "p", ["ancestry"], "gene"), "p", ["ancestry"], "gene")
    return d.select("ancestry", "gene", r("q"), r("holm"))


@query("""
, g AS (SELECT gene, pvalue AS p, row_number() OVER (PARTITION BY gene ORDER BY pvalue) AS i, count(*) OVER (PARTITION BY gene) AS n FROM scored)
SELECT gene, round(least(1, min(p * n / i)), 6) AS simes, round(0.5 - atan(avg(tan((0.5 - greatest(1e-15, least(1 - 1e-15, p))) * pi()))) / pi(), 6) AS acat FROM g GROUP BY 1
""")
def combined_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank and by sum, without a list of a gene's values."""
    d = scored(spark, sf_dir).select("gene", "pvalue")
    return ranks.combined(d, ["gene"], "pvalue").select("gene", r("simes"), r("acat"))


@query("""
, v AS (SELECT ancestry, maf, sum(weight) AS w FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY ancestry ORDER BY maf ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY ancestry) AS total FROM v)
SELECT ancestry, min(maf) FILTER (cum >= 0.25 * total) AS q25, min(maf) FILTER (cum >= 0.9 * total) AS q90 FROM c GROUP BY 1
""")
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "maf", "weight")
    return ranks.weighted_quantile(d, "maf", "weight", ["ancestry"], 0.25, "q25").join(ranks.weighted_quantile(d, "maf", "weight", ["ancestry"], 0.9, "q90"), "ancestry")


@query(", t AS (SELECT unnest(range(0, 161)) / 20.0::DOUBLE AS t) SELECT ancestry, t, round(sum(weight) FILTER (-log10(greatest(pvalue, 1e-300)) <= t) / sum(weight), 6) AS share FROM scored, t GROUP BY 1, 2".replace("sum(weight) FILTER", "coalesce(sum(weight) FILTER").replace("<= t) / ", "<= t), 0) / "))
def weighted_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight is summed per first grid point it counts for, so rows are not repeated per grid point."""
    x = -F.log10(F.greatest("pvalue", F.lit(1e-300)))
    at = F.least(F.greatest(F.ceil(x * 20), F.lit(0)), F.lit(161)).cast("long")
    at = F.when((at > 0) & (x <= (at - 1) / 20.0), at - 1).otherwise(at)
    d = scored(spark, sf_dir).select("ancestry", "weight", at.alias("i")).groupBy("ancestry", "i").agg(F.sum("weight").alias("w"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(160)), lambda t: F.struct((t / 20.0).alias("t"), (F.aggregate(F.filter("s", lambda e: e["i"] <= t), F.lit(0.0), lambda a, e: a + e["w"]) / F.col("total")).alias("share")))
    g = d.groupBy("ancestry").agg(F.collect_list(F.struct("i", "w")).alias("s"), F.sum("w").alias("total"))
    return g.select("ancestry", F.explode(grid).alias("g")).select("ancestry", "g.t", r("g.share", "share"))


# AUROC and resampling ---------------------------------------------------------------------------------------------

RANKED = ", rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE AS rk"


@query("""
, u AS (SELECT ancestry, tool, abs(score) AS s, pip, cs FROM (UNPIVOT (SELECT ancestry, pip, cs, borzoi, alphagenome FROM scored) ON borzoi, alphagenome INTO NAME tool VALUE score)),
g AS (SELECT ancestry, tool, threshold, mode, s, pip >= threshold AS pos FROM u, (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS threshold), (SELECT unnest(['standard', 'rest']) AS mode)
  WHERE pip >= threshold OR (mode = 'standard' AND pip < 0.01) OR (mode = 'rest' AND pip >= 0.01 AND pip < threshold)),
k AS (SELECT *""" + RANKED.format(by="ancestry, tool, threshold, mode", x="s") + """ FROM g)
SELECT ancestry, tool, threshold, mode, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos), 0), 6) AS auroc FROM k GROUP BY 1, 2, 3, 4
""")
def auroc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).unpivot(["ancestry", "pip", "cs"], ["borzoi", "alphagenome"], "tool", "score")
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("mode")) for t in (0.5, 0.9) for m in ("standard", "rest")])
    d = long.select("ancestry", "tool", F.abs("score").alias("s"), "pip", F.explode(grid).alias("g")).select("*", "g.threshold", "g.mode").where("pip >= threshold or (mode = 'standard' and pip < 0.01) or (mode = 'rest' and pip >= 0.01 and pip < threshold)")
    return auroc.auroc(d, "s", F.col("pip") >= F.col("threshold"), ["ancestry", "tool", "threshold", "mode"]).select("ancestry", "tool", "threshold", "mode", r("auroc"))


@query(", k AS (SELECT ancestry, maf_bin, pip >= 0.5 AS pos" + RANKED.format(by="ancestry, maf_bin", x="abs(borzoi)") + " FROM scored WHERE pip >= 0.5 OR pip < 0.01) SELECT ancestry, maf_bin, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 6) AS auroc FROM k GROUP BY 1, 2 HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0")
def auroc_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).where("pip >= 0.5 or pip < 0.01").withColumn("s", F.abs("borzoi"))
    return auroc.auroc(d, "s", F.col("pip") >= 0.5, ["ancestry", "maf_bin"]).where("auroc is not null").select("ancestry", "maf_bin", r("auroc"))


@query(", p AS (SELECT ancestry, pvalue AS v, sum(CASE WHEN pip >= 0.5 THEN weight ELSE 0 END) AS t, sum(CASE WHEN pip >= 0.5 THEN 0 ELSE weight END) AS o FROM scored GROUP BY 1, 2), q AS (SELECT *, sum(o) OVER (PARTITION BY ancestry) - sum(o) OVER (PARTITION BY ancestry ORDER BY v ROWS UNBOUNDED PRECEDING) AS above FROM p) SELECT ancestry, round(sum(t * (above + o / 2)) / (sum(t) * sum(o)), 6) AS superiority FROM q GROUP BY 1")
def weighted_superiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller p-values are better: the same kernel on -p."""
    d = scored(spark, sf_dir).withColumn("v", -F.col("pvalue"))
    return auroc.superiority(d, "v", F.col("pip") >= 0.5, F.col("weight"), ["ancestry"], "superiority").select("ancestry", r("superiority"))


DRAW = "(('0x' || substr(sha256({}), 1, 8))::UBIGINT % {} + 1)::BIGINT"


@query("""
, c AS (SELECT ancestry, pair_key, abs(borzoi) AS s, pip >= 0.5 AS pos, log10(greatest(abs(distance), 1)) AS x FROM scored WHERE pip >= 0.5 OR pip < 0.01),
e AS (SELECT ancestry, list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM c GROUP BY 1),
b AS (SELECT c.*, greatest(1, len(list_filter(edges, lambda z: z < x)))::BIGINT AS bin FROM c JOIN e USING (ancestry)),
neg AS (SELECT ancestry, bin, s, row_number() OVER (PARTITION BY ancestry, bin ORDER BY pair_key) AS i FROM b WHERE NOT pos), sz AS (SELECT ancestry, bin, max(i) AS n FROM neg GROUP BY 1, 2),
d AS (SELECT b.ancestry, b.bin, rep, b.s, """ + DRAW.format("'42|' || b.ancestry || '|' || b.bin || '|' || rep || '|' || b.pair_key", "n") + """ AS i FROM b JOIN sz ON b.ancestry = sz.ancestry AND b.bin = sz.bin, (SELECT unnest(range(1, 101)) AS rep) WHERE b.pos),
j AS (SELECT d.ancestry, rep, d.s AS ps, neg.s AS ns FROM d JOIN neg ON d.ancestry = neg.ancestry AND d.bin = neg.bin AND d.i = neg.i),
l AS (SELECT ancestry, rep, ps AS s, true AS pos FROM j UNION ALL SELECT ancestry, rep, ns, false FROM j),
k AS (SELECT *""" + RANKED.format(by="ancestry, rep", x="s") + """ FROM l),
a AS (SELECT ancestry, rep, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) AS a FROM k GROUP BY 1, 2)
SELECT ancestry, count(*) AS draws, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM a GROUP BY 1
""")
def distance_matched_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: AUROC over distance-balanced resamples."""
    d = scored(spark, sf_dir).where("pip >= 0.5 or pip < 0.01").select("ancestry", "pair_key", F.abs("borzoi").alias("score"), "pip", bins.log_distance(F.col("distance")).alias("x"))
    out = auroc.bootstrap_auroc(d, F.col("pip") >= 0.5, "x", ["ancestry"], "pair_key", 100)
    return out.select("ancestry", "draws", *map(r, ("mean", "sd", "low", "high")))


@query("""
, c AS (SELECT DISTINCT ancestry, gene FROM scored), i AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY gene) AS i, count(*) OVER (PARTITION BY ancestry) AS n FROM c),
m AS (SELECT ancestry, rep, """ + DRAW.format("'42|' || ancestry || '|' || rep || '|' || i", "n") + """ AS j FROM i, (SELECT unnest(range(1, 1001)) AS rep)),
s AS (SELECT ancestry, gene, sum(weight) FILTER (pip >= 0.5) AS top, sum(weight) AS total FROM scored GROUP BY 1, 2),
b AS (SELECT m.ancestry, rep, sum(coalesce(top, 0)) / sum(total) AS x FROM m JOIN i ON m.ancestry = i.ancestry AND m.j = i.i JOIN s ON s.ancestry = i.ancestry AND s.gene = i.gene GROUP BY 1, 2)
SELECT ancestry, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS se, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM b GROUP BY 1
""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    sums = d.groupBy("ancestry", "gene").agg(F.sum(F.when(F.col("pip") >= 0.5, F.col("weight")).otherwise(0.0)).alias("top"), F.sum("weight").alias("total"))
    x = auroc.bootstrap_ratio(sums, auroc.multiplicities(d, "gene", ["ancestry"], 1000), "gene", ["ancestry"], "top", "total")
    return x.groupBy("ancestry").agg(r(F.avg("ratio"), "mean"), r(F.stddev_samp("ratio"), "se"), r(F.percentile("ratio", F.lit(0.025)), "low"), r(F.percentile("ratio", F.lit(0.975)), "high"))


@query("""
, c AS (SELECT DISTINCT gene FROM scored), i AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i, count(*) OVER () AS n FROM c),
m AS (SELECT rep, """ + DRAW.format("'42|all|' || rep || '|' || i", "n") + """ AS j FROM i, (SELECT unnest(range(1, 1001)) AS rep)),
s AS (SELECT ancestry, gene, avg(borzoi) AS top FROM scored GROUP BY 1, 2),
v AS (SELECT ancestry, rep, avg(top) AS v FROM m JOIN i ON m.j = i.i JOIN s ON s.gene = i.gene GROUP BY 1, 2),
d AS (SELECT a.ancestry || '-' || b.ancestry AS contrast, a.v - b.v AS d FROM v a JOIN v b ON a.rep = b.rep AND a.ancestry < b.ancestry),
p AS (SELECT contrast, avg(d) AS mean, least(1, 2 * least((count(*) FILTER (d <= 0) + 1) / (count(*) + 1)::DOUBLE, (count(*) FILTER (d >= 0) + 1) / (count(*) + 1)::DOUBLE)) AS p FROM d GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p, contrast) AS rk, count(*) OVER () AS n FROM p)
SELECT contrast, round(mean, 6) AS mean, round(p, 6) AS p, round(least(1, max(p * (n - rk + 1)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM k
""")
def group_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences of groups over shared replicates, sign p and Holm within the family."""
    d = scored(spark, sf_dir)
    sums = d.groupBy("ancestry", "gene").agg(F.avg("borzoi").alias("top"), F.lit(1.0).alias("total"))
    genes = d.select(F.lit("all").alias("family"), "gene").distinct()
    x = sums.join(auroc.multiplicities(genes, "gene", ["family"], 1000), "gene").groupBy("ancestry", "replicate").agg((F.sum(F.col("m") * F.col("top")) / F.sum(F.col("m") * F.col("total"))).alias("v"))
    wide = x.groupBy("replicate").pivot("ancestry", ["AA", "CH", "NHW"]).agg(F.first("v"))
    pairs = wide.select("replicate", F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for a, b in (("AA", "CH"), ("AA", "NHW"), ("CH", "NHW"))])).alias("c")).select("c.*")
    return ranks.holm(pairs.groupBy("contrast").agg(F.avg("d").alias("mean"), stats.sign_p(F.col("d")).alias("p")).withColumn("family", F.lit(1)), "p", ["family"], "contrast").select("contrast", r("mean"), r("p"), r("holm"))


# Matching, enrichment, graph --------------------------------------------------------------------------------------


@query()
def control_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 draws of up to 10 controls from the nearest 12; positions of positives give no controls in their group."""
    d = scored(spark, sf_dir).where("pip >= 0.9 or pip < 0.01").withColumn("p", F.col("pip") >= 0.9).withColumn("ld", bins.log_distance(F.col("distance")))
    d = d.withColumn("taken", F.max("p").over(W.partitionBy("ancestry", "chrom", "position"))).where("p or not taken")
    return matching.nearest_pool_controls(d, ["ancestry", "tss_bin", "maf_bin"], "pair_key", "gene", "p", {"ld": (0.75, 0.2), "maf": (0.1, 0.02)}, 10, 12, 100)


@query()
def nearest_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).where("pip >= 0.5 and ancestry <> 'NHW'").select("tss_bin", "maf_bin", "pair_key", (F.col("ancestry") == "AA").cast("int").alias("side"), F.abs("alphagenome").alias("z"))
    return matching.nearest_pairs(d, ["tss_bin", "maf_bin"], "pair_key", "side", "z", 0.05)


@query(f"""
, d AS (SELECT tss_bin, pair_key, ancestry = 'AA' AS side, row_number() OVER (PARTITION BY tss_bin, ancestry = 'AA' ORDER BY ('0x' || substr(sha256('3|' || pair_key), 1, 8))::UBIGINT, pair_key) AS i FROM scored WHERE pip >= 0.5 AND ancestry <> 'NHW')
SELECT a.tss_bin AS tss_bin, a.pair_key AS treated, b.pair_key AS control FROM d a JOIN d b ON a.tss_bin = b.tss_bin AND a.i = b.i WHERE a.side AND NOT b.side
""")
def random_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).where("pip >= 0.5 and ancestry <> 'NHW'").select("tss_bin", "pair_key", (F.col("ancestry") == "AA").cast("int").alias("side"))
    return matching.hash_pairs(d, ["tss_bin"], "pair_key", "side")


@query()
def covariate_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sets of matching covariates over the same positives, with what each leaves unbalanced."""
    d = scored(spark, sf_dir).where("pip >= 0.5 and ancestry <> 'NHW'").select("tss_bin", "maf_bin", "pair_key", (F.col("ancestry") == "AA").cast("int").alias("side"), F.abs("alphagenome").alias("z"))
    sets = {"tss_only": (["tss_bin"], False), "tss_maf": (["tss_bin", "maf_bin"], False), "tss_z": (["tss_bin"], True), "z_only": ([], True), "tss_maf_z": (["tss_bin", "maf_bin"], True)}
    both = matching.ablation(d, sets, "pair_key", "side", "z", 0.05, ["tss_bin", "maf_bin"])
    both = materialize(both.select("covariates", "gap", *[(F.col(f"{c}_{n}") == v).cast("double").alias(f"{a}_{n}") for a, c, v, n in (("near", "tss_bin", "0-3kb", "treated"), ("near", "tss_bin", "0-3kb", "control"), ("rare", "maf_bin", "<0.05", "control"))]), "ablation-pairs")
    out = both.groupBy("covariates").agg(F.count(F.lit(1)).alias("pairs"), *[r(F.avg(c), c) for c in ("near_treated", "near_control", "rare_control")]).join(ranks.median(both, ["covariates"], "gap", "median_gap"), "covariates")
    return out.select("covariates", "pairs", r("median_gap"), "near_treated", "near_control", "rare_control")


@query("SELECT ancestry, tss_bin, round(avg(maf) FILTER (pip >= 0.5), 6) AS mean_1, round(avg(maf) FILTER (pip < 0.5), 6) AS mean_0, round((avg(maf) FILTER (pip >= 0.5) - avg(maf) FILTER (pip < 0.5)) / sqrt((var_samp(maf) FILTER (pip >= 0.5) + var_samp(maf) FILTER (pip < 0.5)) / 2), 6) AS smd FROM scored GROUP BY 1, 2")
def covariate_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.balance(scored(spark, sf_dir).withColumn("t", F.col("pip") >= 0.5), ["ancestry", "tss_bin"], "t", "maf").select("ancestry", "tss_bin", r("mean_1"), r("mean_0"), r("smd"))


@query("""
, t AS (SELECT ancestry, gene, count(*) FILTER (borzoi > 0 AND pip >= 0.5)::DOUBLE AS a, count(*) FILTER (borzoi > 0 AND pip < 0.5)::DOUBLE AS b, count(*) FILTER (borzoi <= 0 AND pip >= 0.5)::DOUBLE AS c, count(*) FILTER (borzoi <= 0 AND pip < 0.5)::DOUBLE AS d, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2)
SELECT ancestry, count(*) FILTER (a + b > 0 AND c + d > 0) AS informative, round(ln(sum(a * d / n) / sum(b * c / n)), 6) AS log_or, round(pow(sum(a - (a + b) * (a + c) / n), 2) / sum(CASE WHEN n > 1 THEN (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)) END), 6) AS chi2 FROM t GROUP BY 1
""")
def mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "gene", (F.col("borzoi") > 0).alias("e"), (F.col("pip") >= 0.5).alias("c"))
    return matching.mantel_haenszel(d, ["ancestry"], ["gene"], "e", "c").select("ancestry", "informative", r("log_or"), r("chi2"))


@query("""
, t AS (SELECT ancestry, count(*) FILTER (tss_bin = '0-3kb' AND pip >= 0.5) AS a, count(*) FILTER (tss_bin = '0-3kb' AND pip < 0.5) AS b, count(*) FILTER (tss_bin <> '0-3kb' AND pip >= 0.5) AS c, count(*) FILTER (tss_bin <> '0-3kb' AND pip < 0.5) AS d FROM scored GROUP BY 1)
SELECT ancestry, a, b, c, d, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds FROM t
""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, pos = F.col("tss_bin") == "0-3kb", F.col("pip") >= 0.5
    d = scored(spark, sf_dir).groupBy("ancestry").agg(F.count_if(near & pos).alias("a"), F.count_if(near & ~pos).alias("b"), F.count_if(~near & pos).alias("c"), F.count_if(~near & ~pos).alias("d"))
    return d.withColumn("odds", r((F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5)), "odds"))


@query()
def conditional_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contingency(spark, sf_dir).select("ancestry", stats.conditional_odds("a", "b", "c", "d").alias("x"))
    return d.select("ancestry", r("x.odds", "odds"), r("x.low", "low"), r("x.high", "high"))


@query("""
, t AS (SELECT ancestry, count(*) FILTER (tss_bin = '0-3kb' AND pip >= 0.5) AS a, count(*) FILTER (tss_bin = '0-3kb' AND pip < 0.5) AS b, count(*) FILTER (tss_bin <> '0-3kb' AND pip >= 0.5) AS c, count(*) FILTER (tss_bin <> '0-3kb' AND pip < 0.5) AS d FROM scored GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a - d)::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS x FROM t),
l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp FROM x),
f AS (SELECT ancestry, least(1, sum(exp(lp)) FILTER (lp <= here + 1e-7)) AS fisher FROM (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY ancestry) AS here FROM l) GROUP BY 1),
z AS (SELECT ancestry, abs(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))) / sqrt(2.0::DOUBLE) AS z FROM t),
e AS (SELECT ancestry, 1 - 2 / sqrt(pi()) * sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(z, 1e-12)) - lgamma(k + 1)) / (2 * k + 1)) AS z_p FROM z, (SELECT unnest(range(0, 80)) AS k) GROUP BY 1)
SELECT ancestry, round(fisher, 6) AS fisher, round(z_p, 6) AS z_p FROM f JOIN e USING (ancestry)
""")
def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contingency(spark, sf_dir)
    return d.select("ancestry", r(stats.fisher_exact("a", "b", "c", "d"), "fisher"), r(stats.normal_p(F.log("odds")), "z_p"))


@query("""
, v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 1 = 0),
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.e AS x, b.e AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
u AS (SELECT label, a, b, unnest(x) AS x, unnest(y) AS y FROM p), k AS (SELECT label, a, b, pow(corr(x, y), 2) AS r2 FROM u GROUP BY 1, 2, 3)
SELECT label, count(*) AS pairs, round(avg(r2), 6) AS mean, round(max(r2), 6) AS top FROM k GROUP BY 1
""".replace(" WHERE vec_id % 1 = 0", "").replace("\n, v", "\nWITH v", 1), False)
def pairwise_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linkage.pair_summary(table(spark, sf_dir, "embeddings", "label", "vec_id", "embedding"), "label", "vec_id", "embedding")
    return p.select("label", "pairs", r("mean"), r("top"))


@query()
def clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings", "label", "vec_id", "embedding").withColumn("priority", hashing.uniform(F.col("vec_id").cast("string")))
    return linkage.clump_vectors(nodes, "label", "vec_id", "priority", "embedding", 0.1).withColumn("r2", r("r2"))


#: Links of embeddings within their label, both ways.
LINKS = """
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, unnest(a.e) AS x, unnest(b.e) AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
k AS (SELECT a, b, pow(corr(x, y), 2) AS r2 FROM u GROUP BY a, b HAVING pow(corr(x, y), 2) >= 0.1),
t AS (SELECT a, b, r2 FROM k UNION ALL SELECT b, a, r2 FROM k)
"""


@query(LINKS + "SELECT a, count(*) AS neighbours, round(1 + sum(r2), 6) AS score, round(max(r2), 6) AS strongest, count(*) FILTER (r2 >= 0.8) AS over_80, count(*) FILTER (r2 >= 0.5) AS over_50, count(*) FILTER (r2 >= 0.2) AS over_20 FROM t GROUP BY 1", False)
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linkage.pair_degrees(table(spark, sf_dir, "embeddings", "label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.1)
    return d.withColumns({c: r(c) for c in ("score", "strongest")})


# Label transfer, regression, contracts ----------------------------------------------------------------------------


@query("""
, b AS (SELECT gene, ancestry, max(pip) AS pip, max(cs) AS cs FROM scored GROUP BY 1, 2), w AS (SELECT gene, max(pip) FILTER (ancestry = 'AA') AS a, max(pip) FILTER (ancestry = 'CH') AS c, max(pip) FILTER (ancestry = 'NHW') AS n FROM b GROUP BY 1)
SELECT gene, CASE WHEN a IS NULL THEN 'absent' WHEN a >= 0.9 THEN 'positive' WHEN a >= 0.5 THEN 'supported' ELSE 'weak' END AS status_aa, CASE WHEN c IS NULL THEN 'absent' WHEN c >= 0.9 THEN 'positive' WHEN c >= 0.5 THEN 'supported' ELSE 'weak' END AS status_ch, CASE WHEN n IS NULL THEN 'absent' WHEN n >= 0.9 THEN 'positive' WHEN n >= 0.5 THEN 'supported' ELSE 'weak' END AS status_nhw FROM w
""")
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = scored(spark, sf_dir).groupBy("gene").pivot("ancestry", ["AA", "CH", "NHW"]).agg(F.max("pip"))
    status = lambda c: F.when(F.col(c).isNull(), "absent").when(F.col(c) >= 0.9, "positive").when(F.col(c) >= 0.5, "supported").otherwise("weak")
    return w.select("gene", *[status(c).alias(f"status_{c.lower()}") for c in ("AA", "CH", "NHW")])


@query("""
, m AS (SELECT gene, sum(weight * pip) / sum(weight) AS mp, sum(weight * maf) / sum(weight) AS mm FROM scored GROUP BY 1), d AS (SELECT s.weight AS w, s.pip - mp AS y, s.maf - mm AS x FROM scored s JOIN m USING (gene))
SELECT 'maf' AS term, round(sum(w * x * y) / sum(w * x * x), 6) AS estimate FROM d
""")
def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regress.demean(scored(spark, sf_dir).select("gene", "weight", "pip", "maf"), ["pip", "maf"], "weight", "gene")
    return regress.clustered_wls(d, "pip", ["maf"], "weight", "gene").select("term", r("estimate"))


@query()
def clustered_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("gene", "weight", "pip", "maf", bins.log_distance(F.col("distance")).alias("ld"), F.lit(1.0).alias("one"))
    return regress.clustered_wls(d, "pip", ["one", "maf", "ld"], "weight", "gene").select("term", r("estimate"), r("se"), r(F.col("t") * F.col("t"), "wald"), r(stats.normal_p(F.col("t")), "p"))


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select((F.col("pip") >= 0.5).cast("double").alias("y"), F.lit(1.0).alias("one"), F.abs("borzoi").alias("b"), "maf")
    return regress.logistic(d, "y", ["one", "b", "maf"]).select("term", r("estimate"))


def _design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Positives against low evidence: standardised log score, spline of log distance, log frequency."""
    d = scored(spark, sf_dir).where("(pip >= 0.5 or pip < 0.01) and maf > 0")
    lx = F.log10(F.abs("borzoi") + 1e-6)
    m = d.agg(F.avg(lx).alias("_m"), F.stddev_samp(lx).alias("_s"))
    d = d.join(F.broadcast(m), F.lit(True)).select("ancestry", "gene", (F.col("pip") >= 0.5).cast("double").alias("y"), F.lit(1.0).alias("one"), ((lx - F.col("_m")) / F.col("_s")).alias("x"), F.log10("maf").alias("log_maf"), bins.log_distance(F.col("distance")).alias("log_dist"))
    d, spline = glm.with_spline(d, "log_dist", ["ancestry"])
    return d, ["one", "x", *spline, "log_maf"]


def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, xs = _design(spark, sf_dir)
    return glm.fit(d, ["ancestry"], "y", xs, "gene").where("term = 'x'")


@query()
def spline_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, z = _slopes(spark, sf_dir), 1.96 * F.col("se")
    return s.select("ancestry", "n", "converged", r("estimate"), r("se"), r(F.exp("estimate"), "odds"), r(F.exp(F.col("estimate") - z), "low"), r(F.exp(F.col("estimate") + z), "high"))


@query()
def slope_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = glm.contrasts(_slopes(spark, sf_dir), [], "ancestry", [("AA", "NHW"), ("AA", "CH"), ("CH", "NHW")])
    return d.select("contrast", *map(r, ("difference", "se", "z", "p", "ratio")))


@query()
def leave_one_gene_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, xs = _design(spark, sf_dir)
    return glm.leave_one_out(d.where("ancestry = 'AA'"), "y", xs, "gene").where("term = 'x'").select("left_out", "n", "converged", r("estimate"), r("se"))


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of held-out predictions, folds by gene."""
    d = scored(spark, sf_dir).where("pip >= 0.5 or pip < 0.01").select("ancestry", "gene", (F.col("pip") >= 0.5).cast("double").alias("y"), F.lit(1.0).alias("one"), F.abs("borzoi").alias("b"), bins.log_distance(F.col("distance")).alias("ld"))
    p = glm.cross_validated(d, ["ancestry"], "y", ["one", "b", "ld"], "gene").where("predicted is not null")
    return auroc.auroc(p, "predicted", F.col("y") == 1, ["ancestry"]).select("ancestry", r("auroc"))


@query("""
SELECT 'unique pair_key' AS "check", CASE WHEN count(*) = count(DISTINCT pair_key) THEN 'pass' ELSE 'fail' END AS status, (count(*) - count(DISTINCT pair_key))::BIGINT AS details FROM scored
UNION ALL SELECT 'complete bins', CASE WHEN count(*) FILTER (tss_bin IS NULL OR maf_bin IS NULL) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (tss_bin IS NULL OR maf_bin IS NULL) FROM scored
UNION ALL SELECT 'pip in [0, 1]', CASE WHEN count(*) FILTER (pip < 0 OR pip > 1) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (pip < 0 OR pip > 1) FROM scored
""")
def validation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    return contracts.ledger(contracts.unique(d, "unique pair_key", "pair_key"), contracts.complete(d, "complete bins", "tss_bin", "maf_bin"), contracts.check(d, "pip in [0, 1]", (F.col("pip") < 0) | (F.col("pip") > 1)))


@query("SELECT gene, round(max(pip) - min(pip), 6) AS spread, count(*) AS n FROM scored GROUP BY 1 HAVING max(pip) - min(pip) > 0.9")
def score_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.conflicts(scored(spark, sf_dir), ["gene"], "pip", 0.9).select("gene", r("spread"), "n")


@query("""
, old AS (SELECT pair_key, borzoi FROM scored WHERE cs = 1), w AS (SELECT s.pair_key, coalesce(old.borzoi, s.alphagenome) AS score, CASE WHEN old.pair_key IS NULL THEN 'new' ELSE 'reused' END AS source FROM scored s LEFT JOIN old USING (pair_key))
SELECT source, count(*) AS n, round(avg(score), 6) AS mean FROM w GROUP BY 1
""")
def reuse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known scores by key; only the rest is computed."""
    d = scored(spark, sf_dir)
    old = d.where("cs = 1").select("pair_key", F.col("borzoi").alias("score"), F.lit("reused").alias("source"))
    new = d.join(old, "pair_key", "left_anti").select("pair_key", F.col("alphagenome").alias("score"), F.lit("new").alias("source"))
    return old.unionByName(new).groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.avg("score"), "mean"))
