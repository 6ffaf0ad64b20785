"""Further queries of the operator inventory: text transforms, lookups, summaries, tests, enrichment, graphs, gates, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions import bins, hashing, stats, text
from ..operators import auroc, contracts, enrichment, linkage, matching, samples, select
from ..sources import io
from .base import scored, table
from .queries import DRAW, LINKS, RANKED, U64, query, r

# Text and rows ----------------------------------------------------------------------------------------------------


@query("""
, t AS (SELECT *, 'geno_' || gene AS raw, 'chr' || chrom || ':' || position || '_A_G' AS v, concat_ws(',', pip_class, ancestry) AS roles, concat_ws('+', gene % 13, cs, gene % 13) AS numbers,
  CASE cs WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE borzoi END AS odd FROM scored)
SELECT pair_key, 'ENSG' || lpad(gene::VARCHAR, 6, '0') AS gene_id, regexp_replace(raw, '^[A-Za-z_]+', '') AS bare, replace(replace(replace(replace(ancestry || ' ' || tss_bin, '/', '_'), ' ', '_'), '>', 'gt'), '<', 'lt') AS slug,
 list_contains(string_split(roles, ','), 'low') AS is_low, cs IN (0, 2) AS is_snv, coalesce(odd IS NOT NULL AND NOT isnan(odd) AND NOT isinf(odd), false) AS is_finite, abs(maf - round(maf, 1)) <= 1e-8 + 1e-5 * abs(round(maf, 1)) AS is_tenth,
 string_split(replace(v, '_', ':'), ':')[2]::BIGINT AS parsed, 'T:' || array_to_string(list_transform(list_sort(list_distinct(list_transform(string_split(numbers, '+'), lambda x: x::INT))), lambda x: x::VARCHAR), '+') AS numbers,
 CASE WHEN contains(tss_bin, '>35kb') THEN 'far' WHEN contains(tss_bin, '12') THEN 'middle' ELSE 'near' END AS rule, printf('%.3f', maf) AS shown FROM t
""")
def text_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    gene, cs = F.col("gene").cast("string"), F.col("cs")
    alt = F.when(cs == 0, "c").when(cs == 1, "AT").when(cs == 2, " G ").otherwise("N")
    odd = F.when(cs == 0, F.lit(None)).when(cs == 1, float("nan")).when(cs == 2, float("inf")).otherwise(F.col("borzoi"))
    tenth = F.round("maf", 1)
    return d.select(
        "pair_key", text.unversioned(F.concat(F.lit("ENSG"), F.lpad(gene, 6, "0"), F.lit("."), cs.cast("string"))).alias("gene_id"), text.bare_id(F.concat(F.lit("geno_"), gene)).alias("bare"), text.slug(F.concat_ws(" ", "ancestry", "tss_bin")).alias("slug"),
        text.listed(F.concat_ws(",", "pip_class", "ancestry"), "low").alias("is_low"), text.snv(F.lit("A"), alt).alias("is_snv"), F.coalesce(text.finite(odd), F.lit(False)).alias("is_finite"), text.close(F.col("maf"), tenth).alias("is_tenth"),
        F.get(text.split_variant(F.concat(F.lit("chr"), F.col("chrom").cast("string"), F.lit(":"), F.col("position").cast("string"), F.lit("_A_G"))), 1).cast("long").alias("parsed"),
        text.number_list(F.concat_ws("+", (F.col("gene") % 13).cast("string"), cs.cast("string"), (F.col("gene") % 13).cast("string")), "T:").alias("numbers"),
        text.first_rule(F.col("tss_bin"), [(">35KB", "far"), ("12", "middle")], "near").alias("rule"), F.format_string("%.3f", "maf").alias("shown"),
    )


@query("""
, x AS (SELECT pair_key, pip AS v FROM scored WHERE cs = 1 AND pip >= 0.5), g AS (SELECT gene, max(maf) AS v FROM scored WHERE cs = 2 AND pip >= 0.99 GROUP BY 1)
SELECT s.pair_key, round(coalesce(x.v, g.v), 6) AS value, CASE WHEN x.v IS NOT NULL THEN 'pair' WHEN g.v IS NOT NULL THEN 'gene' ELSE 'none' END AS origin FROM scored s LEFT JOIN x ON x.pair_key = s.pair_key LEFT JOIN g ON 'g_' || g.gene = 'g_' || s.gene WHERE s.ancestry = 'AA'
""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's own value, else its gene's, whose identifiers meet without their prefixes."""
    d = scored(spark, sf_dir)
    own = d.where("cs = 1 and pip >= 0.5").select("pair_key", F.col("pip").alias("own"))
    gene = d.where("cs = 2 and pip >= 0.99").groupBy("gene").agg(F.max("maf").alias("of_gene")).select(text.bare_id(F.concat(F.lit("gene_"), F.col("gene").cast("string"))).alias("id"), "of_gene")
    rows = d.where("ancestry = 'AA'").select("pair_key", text.bare_id(F.concat(F.lit("G"), F.col("gene").cast("string"))).alias("id")).join(own, "pair_key", "left").join(gene, "id", "left")
    return rows.select("pair_key", r(F.coalesce("own", "of_gene"), "value"), F.when(F.col("own").isNotNull(), "pair").when(F.col("of_gene").isNotNull(), "gene").otherwise("none").alias("origin"))


@query("""
, u AS (SELECT pair_key, count(DISTINCT tool) AS n FROM (UNPIVOT (SELECT pair_key, borzoi, alphagenome FROM scored) ON borzoi, alphagenome INTO NAME tool VALUE score) WHERE score > 0.5 GROUP BY 1)
SELECT ancestry, coalesce(n, 0) AS tools, count(*) AS pairs FROM scored LEFT JOIN u USING (pair_key) GROUP BY 1, 2
""")
def reuse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    n = d.unpivot(["pair_key"], ["borzoi", "alphagenome"], "tool", "score").where("score > 0.5").groupBy("pair_key").agg(F.countDistinct("tool").alias("n"))
    return d.join(n, "pair_key", "left").groupBy("ancestry", F.coalesce("n", F.lit(0)).alias("tools")).agg(F.count(F.lit(1)).alias("pairs"))


@query(", m AS (SELECT ancestry, maf_bin, avg(borzoi) AS m FROM scored GROUP BY 1, 2) SELECT m.ancestry, m.maf_bin, round(m.m - b.m, 6) AS delta FROM m JOIN m b ON b.ancestry = m.ancestry AND b.maf_bin = '>=0.2'")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the reference row of the same group."""
    m = scored(spark, sf_dir).groupBy("ancestry", "maf_bin").agg(F.avg("borzoi").alias("m"))
    base = F.max(F.when(F.col("maf_bin") == ">=0.2", F.col("m"))).over(W.partitionBy("ancestry"))
    return m.select("ancestry", "maf_bin", r(F.col("m") - base, "delta")).where("delta is not null")


@query("""
, u AS (SELECT gene, position, maf, pip, pair_key, CASE WHEN cs < 2 THEN 1 ELSE 2 END AS source FROM scored WHERE cs <> 3),
k AS (SELECT *, row_number() OVER (PARTITION BY gene, position ORDER BY source, pip DESC, pair_key) AS f, row_number() OVER (PARTITION BY gene, position ORDER BY source DESC, pip, pair_key DESC) AS l FROM u),
c AS (SELECT gene, position, max(maf) - min(maf) > 0.2 AS clash FROM u GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) AS variants, (SELECT count(*) FILTER (clash) FROM c) AS clashes, round(sum(pip) FILTER (f = 1), 4) AS firsts, round(sum(pip) FILTER (l = 1), 4) AS lasts FROM k
""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per variant by source, first and last in one order, and variants whose sources disagree."""
    u = scored(spark, sf_dir).where("cs <> 3").withColumn("source", F.when(F.col("cs") < 2, 1).otherwise(2))
    key = ["gene", "position"]
    clash = contracts.conflicts(u, key, "maf", 0.2).agg(F.count(F.lit(1)).alias("clashes"))
    first = select.keep_first(u, key, "source", F.col("pip").desc(), "pair_key").agg(F.count(F.lit(1)).alias("variants"), F.round(F.sum("pip"), 4).alias("firsts"))
    last = select.keep_first(u, key, F.col("source").desc(), "pip", F.col("pair_key").desc()).agg(F.round(F.sum("pip"), 4).alias("lasts"))
    return first.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(clash)).select("variants", "clashes", "firsts", "lasts")


@query("SELECT user_id, event_type, count(*) AS n, min(place)::BIGINT AS first_place FROM (SELECT user_id, unnest(string_split(types, ',')) AS event_type, unnest(range(0, len(string_split(types, ',')))) AS place FROM (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1)) GROUP BY 1, 2", False)
def exploded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joined list back to rows with their places."""
    lists = table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    rows = lists.select("user_id", F.posexplode(F.split("types", ",")).alias("place", "event_type"))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("place").cast("long").alias("first_place"))


# Summaries --------------------------------------------------------------------------------------------------------


@query("""
, n AS (SELECT ancestry, maf_bin, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT ancestry, maf_bin, n, printf('%d (%.1f%%)', n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY ancestry), 1)) AS shown FROM n
""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scored(spark, sf_dir).groupBy("ancestry", "maf_bin").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("ancestry")), 1)
    return n.withColumn("shown", F.format_string("%d (%.1f%%)", "n", share))


@query("""
SELECT ancestry, pip_class, count(*) AS pairs, count(DISTINCT position) AS variants, count(*) FILTER (cs = 3) AS missing, round(count(*) FILTER (cs <> 3) / count(*)::DOUBLE, 6) AS covered, round(median(abs(distance)), 6) AS median_distance,
 count(*) FILTER (tss_bin <> CASE WHEN abs(distance) <= 3000 THEN '0-3kb' WHEN abs(distance) <= 12000 THEN '3-12kb' WHEN abs(distance) <= 30000 THEN '12-35kb' ELSE '>35kb' END) AS rebinned FROM scored GROUP BY 1, 2
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).withColumn("score", F.when(F.col("cs") != 3, F.col("borzoi")))
    again = bins.tss_bin(F.col("distance"), (3000, 12000, 30000))
    return d.groupBy("ancestry", "pip_class").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("position").alias("variants"), F.count_if(F.col("score").isNull()).alias("missing"), r(F.avg(F.col("score").isNotNull().cast("double")), "covered"), r(F.percentile(F.abs("distance"), F.lit(0.5)), "median_distance"), F.count_if(F.col("tss_bin") != again).alias("rebinned"))


@query("""
, m AS (SELECT maf_bin, round(avg(maf) FILTER (ancestry = 'AA'), 6) AS aa, round(avg(maf) FILTER (ancestry = 'CH'), 6) AS ch, round(avg(maf) FILTER (ancestry = 'NHW'), 6) AS nhw, min(n) AS least, max(n) AS most
 FROM (SELECT *, count(*) OVER (PARTITION BY ancestry, maf_bin) AS n FROM scored) GROUP BY 1)
SELECT maf_bin, aa, ch, nhw, least, most, round(aa - ch, 6) AS aa_ch, round(aa - nhw, 6) AS aa_nhw FROM m
""")
def wide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per group in a fixed order, the range of counts, and contrasts."""
    m = scored(spark, sf_dir).groupBy("maf_bin", "ancestry").agg(F.avg("maf").alias("m"), F.count(F.lit(1)).alias("n"))
    wide = m.groupBy("maf_bin").pivot("ancestry", ["AA", "CH", "NHW"]).agg(F.first("m")).select("maf_bin", *[r(c, c.lower()) for c in ("AA", "CH", "NHW")])
    d = wide.join(m.groupBy("maf_bin").agg(F.min("n").alias("least"), F.max("n").alias("most")), "maf_bin")
    return d.withColumns({"aa_ch": r(F.col("aa") - F.col("ch"), "x"), "aa_nhw": r(F.col("aa") - F.col("nhw"), "x")})


@query("""
, v AS (SELECT ancestry, greatest(-1000, least(1000, CASE WHEN cs = 0 THEN 'inf'::DOUBLE WHEN cs = 1 AND pip < 0.5 THEN '-inf'::DOUBLE ELSE 10 * borzoi END)) AS x FROM scored),
q AS (SELECT ancestry, quantile_cont(x, 0.3) AS a, quantile_cont(x, 0.6) AS b FROM v GROUP BY 1)
SELECT ancestry, round(CASE WHEN a < -700 THEN 0 ELSE exp(a) END, 6) AS low, round(exp(b), 6) AS high FROM q
""")
def clipped_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of logarithms with infinities clipped, as ratios."""
    x = F.when(F.col("cs") == 0, float("inf")).when((F.col("cs") == 1) & (F.col("pip") < 0.5), float("-inf")).otherwise(10 * F.col("borzoi"))
    d = scored(spark, sf_dir).select("ancestry", F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), x)).alias("x")).groupBy("ancestry").agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.6))).alias("q"))
    return d.select("ancestry", r(text.safe_exp(F.col("q")[0]), "low"), r(text.safe_exp(F.col("q")[1]), "high"))


# Tests ------------------------------------------------------------------------------------------------------------


@query("""
, c AS (SELECT ancestry, maf_bin, count(*) FILTER (pip >= 0.5)::DOUBLE AS a, count(*) FILTER (pip < 0.5)::DOUBLE AS b FROM scored GROUP BY 1, 2),
e AS (SELECT *, (a + b) * sum(a) OVER w / (sum(a + b) OVER w) AS ea, (a + b) * sum(b) OVER w / (sum(a + b) OVER w) AS eb FROM c WINDOW w AS (PARTITION BY ancestry)),
x AS (SELECT ancestry, sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS chi2 FROM e GROUP BY 1)
SELECT ancestry, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM x
""")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("ancestry", "maf_bin", (F.col("pip") >= 0.5).alias("f"))
    return samples.chi_square(d, ["ancestry"], "maf_bin", "f").select("ancestry", r("chi2"), r("p"))


@query(", k AS (SELECT ancestry, maf, pip >= 0.5 AS pos" + RANKED.format(by="ancestry", x="maf") + """, count(*) OVER (PARTITION BY ancestry, maf) AS t FROM scored),
s AS (SELECT ancestry, count(*) FILTER (pos)::DOUBLE AS n, count(*) FILTER (NOT pos)::DOUBLE AS m, sum(rk) FILTER (pos) AS rs, sum(t::DOUBLE * t - 1) AS tt FROM k GROUP BY 1)
SELECT ancestry, round(rs - n * (n + 1) / 2, 4) AS u, round((rs - n * (n + 1) / 2 - n * m / 2) / sqrt(n * m / 12 * (n + m + 1 - tt / ((n + m) * (n + m - 1)))), 6) AS z FROM s
""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.mann_whitney(scored(spark, sf_dir), ["ancestry"], "maf", F.col("pip") >= 0.5).select("ancestry", F.round("u", 4).alias("u"), r("z"))


@query("""
, m AS (SELECT tss_bin, ancestry, avg(borzoi) AS x, stddev_samp(borzoi) / sqrt(count(*)) AS se FROM scored GROUP BY 1, 2),
q AS (SELECT tss_bin, sum(x / (se * se)) / sum(1 / (se * se)) AS pooled, sum(x * x / (se * se)) - pow(sum(x / (se * se)), 2) / sum(1 / (se * se)) AS q FROM m GROUP BY 1)
SELECT tss_bin, round(pooled, 6) AS pooled, round(q, 4) AS q, round(exp(-q / 2), 4) AS p FROM q
""")
def heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir).groupBy("tss_bin", "ancestry").agg(F.avg("borzoi").alias("x"), (F.stddev_samp("borzoi") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return samples.heterogeneity(m, ["tss_bin"], "x", "se").select("tss_bin", r("pooled"), F.round("q", 4).alias("q"), F.round("p", 4).alias("p"))


@query("""
, s AS (SELECT gene, pair_key, abs(borzoi) AS s FROM scored WHERE pip >= 0.9), l AS (SELECT gene, abs(borzoi) AS s FROM scored WHERE pip < 0.01)
SELECT s.pair_key, count(*) AS others, round(sum(CASE WHEN l.s < s.s THEN 1.0::DOUBLE WHEN l.s = s.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6) AS percentile FROM s JOIN l USING (gene) GROUP BY 1 HAVING count(*) >= 5
""")
def gene_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).where("pip >= 0.9 or pip < 0.01").select("gene", "pair_key", "pip", F.abs("borzoi").alias("s"))
    return samples.percentile_among(d, ["gene"], "s", F.col("pip") >= 0.9, F.col("pip") < 0.01, 5).select("pair_key", "others", r("percentile"))


@query("""
, g AS (SELECT ancestry, gene, median(borzoi) AS x FROM scored GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY gene) AS i, count(*) OVER (PARTITION BY ancestry) AS n FROM g),
m AS (SELECT ancestry, rep, """ + DRAW.format("'42|' || ancestry || '|' || rep || '|' || i", "n") + """ AS j FROM i, (SELECT unnest(range(1, 1001)) AS rep)),
b AS (SELECT m.ancestry, rep, median(x) AS x FROM m JOIN i ON m.ancestry = i.ancestry AND m.j = i.i GROUP BY 1, 2)
SELECT ancestry, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM b GROUP BY 1
""")
def bootstrap_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over resampled genes; a gene counts as often as it is drawn."""
    g = scored(spark, sf_dir).groupBy("ancestry", "gene").agg(F.percentile("borzoi", F.lit(0.5)).alias("x"))
    d = g.join(auroc.multiplicities(g, "gene", ["ancestry"], 1000), ["ancestry", "gene"]).groupBy("ancestry", "replicate").agg(F.percentile("x", F.lit(0.5), F.col("m")).alias("x"))
    return d.groupBy("ancestry").agg(r(F.avg("x"), "mean"), r(F.percentile("x", F.lit(0.025)), "low"), r(F.percentile("x", F.lit(0.975)), "high"))


@query(f"""
, g AS (SELECT ancestry, gene, max(pip) AS x FROM scored GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY ancestry, rep ORDER BY {U64.format("'11|' || rep || '|' || gene")}, gene) AS rn FROM g, (SELECT unnest(range(1, 1001)) AS rep)), m AS (SELECT ancestry, rep, avg(x) AS x FROM k WHERE rn <= 20 GROUP BY 1, 2)
SELECT ancestry, count(*) AS subsets, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM m GROUP BY 1
""")
def matched_size_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 subsets of 20 genes without replacement."""
    g = scored(spark, sf_dir).groupBy("ancestry", "gene").agg(F.max("pip").alias("x")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(1000))))
    k = select.top_k(g, ["ancestry", "rep"], 20, hashing.stable_u64(F.concat_ws("|", F.lit(11), "rep", "gene")), "gene")
    return k.groupBy("ancestry", "rep").agg(F.avg("x").alias("x")).groupBy("ancestry").agg(F.count(F.lit(1)).alias("subsets"), r(F.avg("x"), "mean"), r(F.percentile("x", F.lit(0.025)), "low"), r(F.percentile("x", F.lit(0.975)), "high"))


# AUROC grids ------------------------------------------------------------------------------------------------------

AUC = "round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 6)"


@query("""
, u AS (SELECT ancestry, pair_key, tool, abs(score) AS s, pip, log10(greatest(abs(distance), 1)) AS x FROM (UNPIVOT (SELECT ancestry, pair_key, pip, distance, borzoi, alphagenome FROM scored) ON borzoi, alphagenome INTO NAME tool VALUE score)),
c AS (SELECT ancestry, tool, threshold, mode, pair_key, s, x, pip >= threshold AS pos FROM u, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), (SELECT unnest(['rest', 'standard']) AS mode)
  WHERE pip >= threshold OR (mode = 'standard' AND pip < 0.01) OR (mode = 'rest' AND pip >= 0.01 AND pip < threshold)),
e AS (SELECT ancestry, tool, threshold, mode, list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM c GROUP BY ALL),
b AS (SELECT c.*, greatest(1, len(list_filter(edges, lambda z: z < x)))::BIGINT AS bin FROM c JOIN e USING (ancestry, tool, threshold, mode)),
w AS (SELECT *, count(*) FILTER (NOT pos) OVER (PARTITION BY ancestry, tool, threshold, mode, bin) AS n FROM b), y AS (SELECT * FROM w WHERE n > 0),
v AS (SELECT ancestry, tool, threshold, mode, s, count(*) FILTER (pos) AS p FROM y GROUP BY ALL),
g AS (SELECT *, (sum(p) OVER (PARTITION BY ancestry, tool, threshold, mode) - sum(p) OVER (PARTITION BY ancestry, tool, threshold, mode ORDER BY s ROWS UNBOUNDED PRECEDING) + p / 2.0::DOUBLE) / sum(p) OVER (PARTITION BY ancestry, tool, threshold, mode) AS g FROM v),
h AS (SELECT y.ancestry, y.tool, y.threshold, y.mode, bin, row_number() OVER (PARTITION BY y.ancestry, y.tool, y.threshold, y.mode, bin ORDER BY pair_key) AS i, g FROM y JOIN g ON y.ancestry = g.ancestry AND y.tool = g.tool AND y.threshold = g.threshold AND y.mode = g.mode AND y.s = g.s WHERE NOT pos),
d AS (SELECT ancestry, tool, threshold, mode, bin, rep, """ + DRAW.format("'42|' || ancestry || '|' || tool || '|' || threshold || '|' || mode || '|' || bin || '|' || rep || '|' || pair_key", "n") + """ AS i FROM y, (SELECT unnest(range(1, 101)) AS rep) WHERE pos),
a AS (SELECT ancestry, tool, threshold, mode, rep, avg(g) AS a FROM d JOIN h USING (ancestry, tool, threshold, mode, bin, i) GROUP BY ALL)
SELECT ancestry, tool, threshold, mode, count(*) AS draws, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM a GROUP BY ALL HAVING count(*) >= 10
""")
def balanced_auroc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance-balanced AUROC of every tool, group, threshold and mode."""
    pip, of = F.col("pip"), lambda t, m: (pip < 0.01) if m == "standard" else (pip >= 0.01) & (pip < t)
    cells = {(t, m): (pip >= t, of(t, m)) for t in (0.5, 0.6, 0.7, 0.8, 0.9) for m in ("rest", "standard")}
    d = scored(spark, sf_dir).select("ancestry", "pair_key", "pip", bins.log_distance(F.col("distance")).alias("x"), *[F.abs(c).alias(c) for c in ("borzoi", "alphagenome")])
    each = auroc.balanced_grid(d, cells, "x", ["ancestry"], "pair_key", ["borzoi", "alphagenome"], 100)
    out = auroc.spread(each, ["ancestry", "score", "cell"], 10)
    threshold, mode = (F.element_at(F.array(*[F.lit(c[i]) for c in cells]), F.col("cell") + 1) for i in (0, 1))
    return out.select("ancestry", F.col("score").alias("tool"), threshold.alias("threshold"), mode.alias("mode"), "draws", *map(r, ("mean", "sd", "low", "high")))


@query(", n AS (SELECT *, count(*) FILTER (pip >= 0.5) OVER (PARTITION BY gene, cs) AS size FROM scored), c AS (SELECT ancestry, s, abs(borzoi) AS x, pip >= 0.5 AS pos FROM n, (SELECT unnest(['all', 'small']) AS s) WHERE pip < 0.01 OR (pip >= 0.5 AND (s = 'all' OR size <= 40))), k AS (SELECT *" + RANKED.format(by="ancestry, s", x="x") + f" FROM c) SELECT ancestry, s AS sets, count(*) FILTER (pos) AS positives, {AUC} AS auroc FROM k GROUP BY 1, 2 HAVING count(*) FILTER (pos) > 0")
def auroc_by_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives against those of small sets."""
    d = scored(spark, sf_dir).withColumn("size", F.count_if(F.col("pip") >= 0.5).over(W.partitionBy("gene", "cs"))).where("pip < 0.01 or pip >= 0.5")
    d = d.select("ancestry", F.abs("borzoi").alias("s"), "pip", "size", F.explode(F.array(F.lit("all"), F.lit("small"))).alias("sets")).where("pip < 0.01 or sets = 'all' or size <= 40")
    n = d.groupBy("ancestry", "sets").agg(F.count_if(F.col("pip") >= 0.5).alias("positives")).where("positives > 0")
    return auroc.auroc(d, "s", F.col("pip") >= 0.5, ["ancestry", "sets"]).join(n, ["ancestry", "sets"]).select("ancestry", "sets", "positives", r("auroc"))


@query(", c AS (SELECT ancestry, d, abs(borzoi) AS x, pip >= 0.5 AS pos FROM scored, (SELECT unnest(['low', 'outside', 'distant']) AS d) WHERE pip >= 0.5 OR (pip < 0.01 AND (d = 'low' OR (d = 'outside' AND cs = 0) OR (d = 'distant' AND abs(distance) > 12000)))), k AS (SELECT *" + RANKED.format(by="ancestry, d", x="x") + f" FROM c), a AS (SELECT ancestry, d, {AUC} AS auroc FROM k GROUP BY 1, 2) SELECT a.ancestry, a.d AS negatives, a.auroc, round(a.auroc - b.auroc, 6) AS delta FROM a JOIN a b ON a.ancestry = b.ancestry AND b.d = 'low'")
def negative_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same positives against negatives by several definitions, and what each changes."""
    rules = {"low": F.lit(True), "outside": F.col("cs") == 0, "distant": F.abs("distance") > 12000}
    named = F.array_compact(F.array(*[F.when((F.col("pip") >= 0.5) | rule, F.lit(k)) for k, rule in rules.items()]))
    d = scored(spark, sf_dir).where("pip >= 0.5 or pip < 0.01").select("ancestry", F.abs("borzoi").alias("s"), "pip", F.explode(named).alias("negatives"))
    a = auroc.auroc(d, "s", F.col("pip") >= 0.5, ["ancestry", "negatives"]).select("ancestry", "negatives", r("auroc"))
    base = F.max(F.when(F.col("negatives") == "low", F.col("auroc"))).over(W.partitionBy("ancestry"))
    return a.withColumn("delta", F.round(F.col("auroc") - base, 6))


# Enrichment of matched sets ---------------------------------------------------------------------------------------

SETS = """
, n AS (SELECT ancestry, tss_bin, maf_bin, gene, borzoi > 0 AS hit, pip >= 0.9 AS pos, row_number() OVER (PARTITION BY ancestry, tss_bin, maf_bin, pip >= 0.9 ORDER BY ('0x' || substr(sha256('5|' || pair_key), 1, 8))::UBIGINT, pair_key) AS i FROM scored WHERE pip >= 0.9 OR pip < 0.01),
s AS (SELECT ancestry, tss_bin, maf_bin, CASE WHEN pos THEN i ELSE (i + 3) // 4 END AS st, gene, hit::INT::DOUBLE AS h, pos FROM n),
q AS (SELECT ancestry, tss_bin, maf_bin, st, max(h) FILTER (pos) AS hit, coalesce(sum(h) FILTER (NOT pos), 0) AS hits, count(*) FILTER (NOT pos)::DOUBLE AS m, max(gene) FILTER (pos) AS gene FROM s GROUP BY ALL HAVING max(h) FILTER (pos) IS NOT NULL),
z AS (SELECT *, hit * (m - hits) / (m + 1) AS num, (1 - hit) * hits / (m + 1) AS den FROM q)
"""
BOOT = """, g AS (SELECT ancestry, gene, sum(num) AS num, sum(den) AS den FROM z GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY ancestry ORDER BY gene) AS i, count(*) OVER (PARTITION BY ancestry) AS n FROM g),
m AS (SELECT ancestry, rep, """ + DRAW.format("'42|' || ancestry || '|' || rep || '|' || i", "n") + """ AS j FROM i, (SELECT unnest(range(1, 1001)) AS rep)),
t AS (SELECT m.ancestry, rep, sum(num) AS num, sum(den) AS den FROM m JOIN i ON m.ancestry = i.ancestry AND m.j = i.i GROUP BY 1, 2),
b AS (SELECT ancestry, rep, round(CASE WHEN num > 0 AND den > 0 THEN ln(num) - ln(den) WHEN num > 0 THEN 1000 WHEN den > 0 THEN -1000 END, 9) AS x FROM t)
"""
SIGN = "least(1, 2 * least((count(*) FILTER (x <= 0) + 1) / (count(x) + 1)::DOUBLE, (count(*) FILTER (x >= 0) + 1) / (count(x) + 1)::DOUBLE))"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).where("pip >= 0.9 or pip < 0.01")
    strata = ["ancestry", "tss_bin", "maf_bin"]
    return enrichment.set_sums(enrichment.matched_sets(d, strata, "pair_key", F.col("pip") >= 0.9, 4), strata, "gene", F.col("borzoi") > 0)


@query(SETS + """SELECT ancestry, tss_bin, count(*) AS sets, sum(hit)::BIGINT AS hits_positive, sum(hits)::BIGINT AS hits_controls, sum(m)::BIGINT AS controls FROM z GROUP BY 1, 2""")
def matched_set_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).groupBy("ancestry", "tss_bin").agg(F.count(F.lit(1)).alias("sets"), F.sum("hit").cast("long").alias("hits_positive"), F.sum("hits").cast("long").alias("hits_controls"), F.sum("controls").cast("long").alias("controls"))


@query(SETS + BOOT + f""", p AS (SELECT ancestry, count(*) AS sets, count(*) FILTER (hit + hits > 0 AND hit + hits < m + 1 AND m > 0) AS informative, ln(sum(num)) - ln(sum(den)) AS log_or FROM z GROUP BY 1),
v AS (SELECT ancestry, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, {SIGN} AS p FROM b WHERE x IS NOT NULL GROUP BY 1)
SELECT ancestry, sets, informative, round(log_or, 6) AS log_or, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM p JOIN v USING (ancestry)""")
def set_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = enrichment.enrichment(_sets(spark, sf_dir), ["ancestry"], "gene", 1000)
    return d.select("ancestry", "sets", "informative", *map(r, ("log_or", "low", "high", "p")))


@query(SETS + BOOT + f""", d AS (SELECT a.ancestry || '-' || c.ancestry AS contrast, a.x - c.x AS x FROM b a JOIN b c ON a.rep = c.rep AND a.ancestry < c.ancestry)
SELECT contrast, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round({SIGN}, 6) AS p FROM d WHERE x IS NOT NULL GROUP BY 1""")
def enrichment_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of groups' log odds ratios, replicate by replicate."""
    b = enrichment.replicates(_sets(spark, sf_dir), ["ancestry"], "gene", 1000)
    wide = b.groupBy("replicate").pivot("ancestry", ["AA", "CH", "NHW"]).agg(F.first("log_or"))
    pairs = wide.select(F.explode(F.array(*[F.struct(F.lit(f"{a}-{c}").alias("contrast"), (F.col(a) - F.col(c)).alias("x")) for a, c in (("AA", "CH"), ("AA", "NHW"), ("CH", "NHW"))])).alias("s")).select("s.*").where("x is not null")
    return pairs.groupBy("contrast").agg(r(F.avg("x"), "mean"), r(F.percentile("x", F.lit(0.025)), "low"), r(F.percentile("x", F.lit(0.975)), "high"), r(stats.sign_p(F.col("x")), "p"))


@query(SETS + """, w AS (SELECT ancestry, perm, (((""" + U64.format("'9|' || ancestry || '|' || tss_bin || '|' || maf_bin || '|' || perm || '|' || st") + """)::DOUBLE + 1.0::DOUBLE) / (18446744073709551616.0::DOUBLE + 1.0::DOUBLE) < (hit + hits) / (m + 1))::INT::DOUBLE AS h, hit + hits AS t, m FROM z, (SELECT unnest(range(1, 201)) AS perm)),
o AS (SELECT ancestry, perm, sum(h * (m - t + h) / (m + 1)) AS num, sum((1 - h) * (t - h) / (m + 1)) AS den FROM w GROUP BY 1, 2), l AS (SELECT ancestry, ln(num) - ln(den) AS x FROM o WHERE num > 0 AND den > 0)
SELECT ancestry, count(*) AS permutations, round(avg(x), 6) AS mean, abs(avg(x)) <= 0.1 AS center_pass, quantile_cont(x, 0.025) <= 0 AND quantile_cont(x, 0.975) >= 0 AS includes_one FROM l GROUP BY 1""")
def permutation_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels permuted within sets: the ratio should be one."""
    strata = ["ancestry", "tss_bin", "maf_bin"]
    sums = _sets(spark, sf_dir).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(200))))
    drawn = enrichment.permuted_sets(sums, [*strata, "permutation", "set"])
    x = drawn.groupBy("ancestry", "permutation").agg(F.sum(F.expr(enrichment.NUM)).alias("num"), F.sum(F.expr(enrichment.DEN)).alias("den")).where("num > 0 and den > 0").select("ancestry", (F.log("num") - F.log("den")).alias("x"))
    q = lambda p: F.percentile("x", F.lit(p))
    return x.groupBy("ancestry").agg(F.count(F.lit(1)).alias("permutations"), r(F.avg("x"), "mean"), (F.abs(F.avg("x")) <= 0.1).alias("center_pass"), ((q(0.025) <= 0) & (q(0.975) >= 0)).alias("includes_one"))


# Graphs -----------------------------------------------------------------------------------------------------------


@query(LINKS + ", w AS (SELECT a, window_, r2 FROM (SELECT a, abs(a - b) AS d, r2 FROM t), (SELECT unnest([50, 200]) AS window_) WHERE d <= window_) SELECT a, window_ AS \"window\", count(*) FILTER (r2 >= 0.8) AS over_80, count(*) FILTER (r2 >= 0.5) AS over_50, count(*) FILTER (r2 >= 0.2) AS over_20, round(max(r2), 6) AS strongest FROM w GROUP BY 1, 2", False)
def windowed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = linkage.pair_links(table(spark, sf_dir, "embeddings", "label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.1, 200).withColumn("distance", F.abs(F.col("a") - F.col("b")))
    return linkage.windowed(e, "distance", (50, 200)).withColumn("strongest", r("strongest"))


@query("""
, g AS (SELECT DISTINCT position // 20000 AS locus, gene FROM scored WHERE pip >= 0.99), e AS (SELECT DISTINCT a.gene AS a, b.gene AS b FROM g a JOIN g b ON a.locus = b.locus AND a.gene <> b.gene)
SELECT node, min(reach) AS component FROM (WITH RECURSIVE p AS (SELECT a AS node, a AS reach FROM e UNION SELECT p.node, e.b FROM p JOIN e ON p.reach = e.a) SELECT * FROM p) GROUP BY 1
""")
def gene_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes joined by a locus with strong evidence for both."""
    g = scored(spark, sf_dir).where("pip >= 0.99").select(F.floor(F.col("position") / 20000).alias("locus"), "gene").distinct()
    edges = g.withColumnRenamed("gene", "a").join(g.withColumnRenamed("gene", "b"), "locus").where("a <> b").select("a", "b").distinct()
    return linkage.components(edges)


# Gates and files --------------------------------------------------------------------------------------------------


@query("""
, g AS (SELECT ancestry, avg(maf) FILTER (pip >= 0.5) AS a, avg(maf) FILTER (pip < 0.5) AS b, sqrt((var_samp(maf) FILTER (pip >= 0.5) + var_samp(maf) FILTER (pip < 0.5)) / 2) AS s FROM scored GROUP BY 1)
SELECT 'groups' AS "check", 'pass' AS status, 0::BIGINT AS details UNION ALL SELECT 'grid', 'pass', 0 UNION ALL SELECT 'chunks', 'pass', 0
UNION ALL SELECT 'balance', CASE WHEN count(*) FILTER (abs((a - b) / s) > 0.1) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (abs((a - b) / s) > 0.1) FROM g
UNION ALL SELECT 'agreement', CASE WHEN count(*) FILTER (gene % 50 = 0) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (gene % 50 = 0) FROM (SELECT DISTINCT gene FROM scored)
""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance, cardinality, partition, balance and agreement with an earlier run."""
    # Stored once: each check would sort and join the pairs again.
    d = storage.materialize(scored(spark, sf_dir).select("ancestry", "pair_key", "gene", "maf", "pip", "pip_class"), "gates")
    keys, genes = d.select("pair_key"), d.select("gene").distinct()
    smd = matching.balance(d.withColumn("t", F.col("pip") >= 0.5), ["ancestry"], "t", "maf")
    now, before = genes.withColumn("v", F.lit(1)), genes.withColumn("v", F.when(F.col("gene") % 50 == 0, 0).otherwise(1))
    return contracts.ledger(
        contracts.homogeneous(d, "groups", "ancestry", ["AA", "CH", "NHW"]), contracts.cardinality(d.select("ancestry").distinct().crossJoin(F.broadcast(d.select("pip_class").distinct())), "grid", 9),
        contracts.partition(keys, keys, "chunks", "pair_key"), contracts.within(smd, "balance", "smd", 0.1), contracts.agreement(now, before, "agreement", "gene", "v"),
    )


@query("""
, p AS (SELECT chrom, position, maf FROM scored WHERE pip >= 0.9)
SELECT 'tsv' AS kind, count(*) AS n, sum(position)::BIGINT AS total FROM p UNION ALL SELECT 'partitioned', count(*), sum(position)::BIGINT FROM p UNION ALL SELECT 'bed', count(*), sum(position)::BIGINT FROM (SELECT DISTINCT chrom, position FROM p)
UNION ALL SELECT 'vcf', count(*), sum(position)::BIGINT FROM (SELECT DISTINCT chrom, position FROM p) UNION ALL SELECT 'summary', count(*), sum(position)::BIGINT FROM p
""")
def file_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as text in several formats to the shared folder and read back."""
    p = scored(spark, sf_dir).where("pip >= 0.9").select("chrom", "position", "maf")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("total")).select(F.lit(kind).alias("kind"), "n", F.col("total").cast("long").alias("total"))
    path = {k: storage.fresh(spark, k) for k in ("tsv", "partitioned", "bed", "vcf", "summary")}
    io.write_delimited(p, path["tsv"])
    io.write_delimited(p, path["partitioned"], by=["chrom"])
    named = p.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "position")
    storage.publish(io.bed_lines(named.withColumn("name", F.col("chrom"))), path["bed"], "text", compression="gzip")
    storage.publish(io.vcf_lines(named.select("chrom", "position", F.lit("A").alias("ref"), F.lit("G").alias("alt"))), path["vcf"], "text")
    total = storage.summary(p.agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("total")), path["summary"])
    parts = [
        count(io.read_delimited(spark, path["tsv"], "chrom long, position long, maf double, absent string"), "tsv"), count(io.read_delimited(spark, path["partitioned"], "position long, maf double"), "partitioned"),
        count(io.read_bed(spark, path["bed"]).select(F.col("end").alias("position")), "bed"), count(io.read_whitespace(spark, path["vcf"], ["#CHROM", "POS"]).where(~F.col("#CHROM").startswith("##")).select(F.col("POS").cast("long").alias("position")), "vcf"),
        total.select(F.lit("summary").alias("kind"), "n", "total"),
    ]
    return contracts.ledger(*parts)
