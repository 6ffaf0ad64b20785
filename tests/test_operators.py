"""Edge cases by hand and brute force on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strataframe.functions import bins, hashing, keys, stats
from strataframe.operators import auroc, contracts, cubes, glm, intervals, linkage, matching, ranks, regress, select
from strataframe.sources import io, plink
from strataframe.streaming import reservoir


def test_bins_at_their_edges(spark):
    d = spark.createDataFrame([(0.0,), (3000.0,), (3000.5,), (12000.0,), (35000.0,), (-40000.0,), (None,)], "d double")
    assert [r[0] for r in d.select(bins.tss_bin(F.col("d"))).collect()] == ["0-3kb", "0-3kb", "3-12kb", "3-12kb", "12-35kb", ">35kb", None]
    m = spark.createDataFrame([(0.0,), (0.05,), (0.2,), (0.5,), (0.6,), (None,)], "m double")
    assert [r[0] for r in m.select(bins.maf_bin(F.col("m"))).collect()] == ["<0.05", "0.05-0.2", ">=0.2", ">=0.2", None, None]
    p = spark.createDataFrame([(0.01,), (0.5,), (0.0099,), (None,)], "p double")
    assert [r[0] for r in p.select(bins.pip_class(F.col("p"))).collect()] == ["intermediate", "positive", "low", "intermediate"]


def test_keys(spark):
    d = spark.createDataFrame([("1",), ("chr1",), ("1.0",), ("x",), (" ",), (None,)], "c string")
    assert [r[0] for r in d.select(keys.chrom(F.col("c"))).collect()] == ["chr1", "chr1", "chr1", "chrX", None, None]
    v = spark.createDataFrame([("chr1:5_A_G",), ("1:5_A_G",), ("chrX:7_AT_C",)], "v string").select(keys.parsed_variant(F.col("v")).alias("p")).collect()
    assert v[1].p is None and v[0].p.position == 5 and v[2].p.ref == "AT"
    n = spark.createDataFrame([("chr10",), ("chr2",), ("chrX",), ("chrUn",)], "c string").orderBy(keys.natural_chrom(F.col("c"))).collect()
    assert [r[0] for r in n] == ["chr2", "chr10", "chrX", "chrUn"]


def test_hash_is_sha256(spark):
    import hashlib

    got = spark.range(5).select(hashing.stable_u64(F.col("id").cast("string"))).collect()
    assert [int(r[0]) for r in got] == [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") for i in range(5)]


def test_p_values(spark):
    d = spark.createDataFrame([([0.01, 0.04, 0.03],), ([1.0],), ([0.0, 0.5],)], "p array<double>")
    s = [r[0] for r in d.select(stats.simes(F.col("p"))).collect()]
    assert s == pytest.approx([0.03, 1.0, 0.0])
    one = spark.createDataFrame([(1.959963984540054, 3, 1, 1, 3)], "z double, a int, b int, c int, d int")
    r = one.select(stats.normal_p(F.col("z")), stats.fisher_exact("a", "b", "c", "d")).first()
    assert r[0] == pytest.approx(0.05) and r[1] == pytest.approx(34 / 70)


def test_auroc_with_ties_and_one_class(spark):
    r = random.Random(3)
    rows = [(g, r.randint(0, 4) / 4, r.random() < 0.4) for g in range(4) for _ in range(30)] + [(9, 1.0, True)]
    got = {x.g: x.auroc for x in auroc.auroc(spark.createDataFrame(rows, "g int, s double, p boolean"), "s", F.col("p"), ["g"]).collect()}
    for g in range(4):
        pos, neg = ([s for h, s, p in rows if h == g and p == side] for side in (True, False))
        want = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want)
    assert got[9] is None


def test_step_up_and_step_down(spark):
    d = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (1, 4, None)], "f int, k int, p double")
    q = {r.k: r.q for r in ranks.benjamini_hochberg(d, "p", ["f"], "k").collect()}
    assert q[1] == pytest.approx(0.03) and q[2] == pytest.approx(0.04) and q[3] == pytest.approx(0.04) and q[4] is None
    h = {r.k: r.holm for r in ranks.holm(d, "p", ["f"], "k").collect()}
    assert h[1] == pytest.approx(0.03) and h[3] == pytest.approx(0.06) and h[2] == pytest.approx(0.06)


def test_islands_touching(spark):
    d = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 10, 20), ("c", 3, 21, 30)], "c string, k int, s long, e long")
    assert [r.island for r in ranks.islands(d, ["c"], "s", "e", "k").orderBy("k").collect()] == [1, 1, 2]


def test_intervals_against_brute_force(spark):
    r = random.Random(4)
    pts = [(i, r.randint(1, 2), r.randint(0, 500)) for i in range(200)]
    ivs = [(j, r.randint(1, 2), a := r.randint(0, 480), a + r.randint(0, 90)) for j in range(60)]
    got = intervals.point_in_interval(spark.createDataFrame(pts, "i int, c int, x long"), spark.createDataFrame(ivs, "j int, c int, s long, e long"), "c", "x", "s", "e", 16)
    assert {(x.i, x.j) for x in got.collect()} == {(i, j) for i, c, x in pts for j, d, s, e in ivs if c == d and s <= x < e}
    assert got.count() == len({(x.i, x.j) for x in got.collect()})


def test_clumps_take_direct_neighbours_only(spark):
    nodes = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (1, "d", 1.0), (2, "e", 1.0)], "g int, k string, p double")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.1), ("a", "e", 0.9)], "a string, b string, r2 double")
    got = {r.k: r["index"] for r in linkage.clump(nodes, edges, "g", "k", "p", 0.5).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_matching_passes(spark):
    rows = [("s", "p1", 1, True, 1.0), ("s", "p2", 1, True, 1.0), ("s", "c1", 1, False, 1.1), ("s", "c2", 2, False, 1.2), ("s", "far", 1, False, 9.0)]
    m = matching.matched_controls(spark.createDataFrame(rows, "s string, k string, g int, p boolean, x double"), ["s"], "k", "g", "p", {"x": 0.5}, 2).collect()
    assert {r.control for r in m} == {"c1", "c2"} and len(m) == 4 and sum(r.reused for r in m) == 2


def test_nearest_pairs(spark):
    rows = [("s", "a", 1, 5.0), ("s", "b", 1, 1.0), ("s", "x", 0, 4.9), ("s", "y", 0, 1.4), ("s", "z", 0, 30.0)]
    m = matching.nearest_pairs(spark.createDataFrame(rows, "s string, k string, side int, v double"), ["s"], "k", "side", "v", 0.3).collect()
    assert [(r.treated, r.control) for r in m] == [("a", "x")]


def test_zero_margins_give_infinite_odds(spark):
    rows = [(1, 1, True, True), (1, 1, False, False), (2, 1, True, False), (2, 1, False, True)]
    m = {r.g: r.log_or for r in matching.mantel_haenszel(spark.createDataFrame(rows, "g int, s int, e boolean, c boolean"), ["g"], ["s"], "e", "c").collect()}
    assert m == {1: math.inf, 2: -math.inf}


def test_regressions(spark):
    import numpy as np

    g = np.random.default_rng(1)
    x, c = g.normal(size=300), g.integers(0, 20, 300)
    y = 2 + 3 * x + g.normal(size=300)
    d = spark.createDataFrame([(float(a), float(b), 1.0, 1.0, int(k)) for a, b, k in zip(x, y, c)], "x double, y double, one double, w double, c int")
    got = {r.term: r for r in regress.clustered_wls(d, "y", ["one", "x"], "w", "c").collect()}
    X = np.stack([np.ones(300), x], 1)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    bread = np.linalg.inv(X.T @ X)
    u = X * (y - X @ beta)[:, None]
    s = np.array([u[c == k].sum(0) for k in np.unique(c)])
    cov = bread @ s.T @ s @ bread * (len(s) / (len(s) - 1)) * (299 / 298)
    assert got["x"].estimate == pytest.approx(beta[1]) and got["x"].se == pytest.approx(math.sqrt(cov[1, 1]))
    z = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "y double, one double")
    assert regress.logistic(z, "y", ["one"]).first().estimate == pytest.approx(math.log(3))


def test_contracts(spark):
    d = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    rows = contracts.ledger(contracts.unique(d, "u", "k"), contracts.complete(d, "c", "v"), contracts.check(d, "ok", F.lit(False)))
    assert {r["check"]: r.status for r in rows.collect()} == {"u": "fail", "c": "fail", "ok": "pass"}
    with pytest.raises(ValueError, match="u, c"):
        contracts.require(rows)


def test_small_strata_are_skipped(spark):
    d = spark.createDataFrame([("a", "x", float(i), float(i)) for i in range(10)] + [("b", "y", float(i), 1.0) for i in range(9)], "a string, b string, u double, v double")
    assert {(r.g1, r.g2) for r in cubes.concordance(d, "a", "b", "u", "v").collect()} == {("All", "All"), ("a", "All"), ("All", "x"), ("a", "x")}


def test_text_sources_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([("chr2", 5, "A", "G"), ("chr10", 7, "C", "T"), ("chr2", 5, "A", "G")], "chrom string, position long, ref string, alt string")
    assert [r.value.split("\t")[:2] for r in io.vcf_lines(d).collect()][2:] == [["chr2", "5"], ["chr10", "7"]]
    io.write_delimited(d, str(tmp_path / "t"))
    back = io.read_delimited(spark, str(tmp_path / "t"), "position long, chrom string, more double", provenance=True)
    assert sorted((r.position, r.chrom, r.more) for r in back.collect()) == [(5, "chr2", None), (5, "chr2", None), (7, "chr10", None)]
    (tmp_path / "b.bed").write_text("#c\nchr1\t1\t5\tx\nchr1\t1\t5\tx\nchr1\tz\t5\ty\nshort\n")
    assert [tuple(r) for r in io.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [("chr1", 1, 5, "x")]
    (tmp_path / "k").write_text("f1 i1\ni2\n")
    assert {r.id for r in io.read_keep_list(spark, str(tmp_path / "k")).collect()} == {"i1", "i2"}
    (tmp_path / "w").write_text("  SNP_A   R2\n a  0.5 \n")
    assert [tuple(r) for r in io.read_whitespace(spark, str(tmp_path / "w"), ["SNP_A", "R2"]).collect()] == [("a", "0.5")]
    assert io.file_digests(spark, str(tmp_path / "k")).count() == 1


def test_reservoir_over_batches_equals_one_pass(spark):
    d = spark.range(200).select((F.col("id") % 3).alias("s"), F.col("id").cast("string").alias("k"))
    priority = hashing.stable_u64(F.col("k"))
    want = {tuple(r) for r in select.top_k(d, ["s"], 5, priority, "k").collect()}
    state = None
    for i in range(4):
        state = reservoir.merge(state, d.where(F.col("k").cast("int") % 4 == i), ["s"], 5, priority, "k")
    assert {tuple(r) for r in state.collect()} == want


def brute_logistic(x, y):
    import numpy as np

    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    return b, 1 / (1 + np.exp(-x @ b))


def test_logistic_fits_by_group(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(g, int(i % 7), float(rng.normal()), float(rng.random())) for g in "ab" for i in range(150)]
    rows = [(g, c, x, z, float(rng.random() < 1 / (1 + math.exp(-x + z)))) for g, c, x, z in rows]
    d = spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0, 1.0), ("a", 1, None, 1.0, 1.0)], "g string, c int, x double, z double, y double").withColumn("one", F.lit(1.0))
    got = {(r.g, r.term): r for r in glm.fit(d, ["g"], "y", ["one", "x", "z"], "c").collect()}
    assert got["c", "x"].estimate is None and not got["c", "x"].converged
    for g in "ab":
        t = [r for r in rows if r[0] == g]
        x, y = np.array([[1, r[2], r[3]] for r in t]), np.array([r[4] for r in t])
        b, mu = brute_logistic(x, y)
        bread = np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)
        s = np.zeros((7, 3))
        np.add.at(s, [r[1] for r in t], x * (y - mu)[:, None])
        se = np.sqrt(np.diag(bread @ s.T @ s @ bread * 7 / 6))
        assert [got[g, n].estimate for n in ("one", "x", "z")] == pytest.approx(b, abs=1e-6) and [got[g, n].se for n in ("one", "x", "z")] == pytest.approx(se, abs=1e-6)
        assert got[g, "x"].n == 150
    left = {r.left_out: r for r in glm.leave_one_out(d.where("g = 'a'"), "y", ["one", "x"], "c").where("term = 'x'").collect()}
    t = [r for r in rows if r[0] == "a" and r[1] != 3]
    assert left[3].estimate == pytest.approx(brute_logistic(np.array([[1, r[2]] for r in t]), np.array([r[4] for r in t]))[0][1], abs=1e-6)
    cv = glm.cross_validated(d.where("g < 'c'"), ["g"], "y", ["one", "x"], "c", folds=3)
    assert cv.count() == 301 and cv.where("predicted is null").count() == 1 and cv.agg(F.max("predicted")).first()[0] < 1


def test_contrasts(spark):
    s = spark.createDataFrame([("a", 1.0, 0.3), ("b", 0.5, 0.4)], "g string, estimate double, se double")
    r = glm.contrasts(s, [], "g", [("a", "b")]).first()
    assert (r.contrast, r.difference, round(r.se, 9), round(r.z, 9)) == ("a_minus_b", 0.5, 0.5, 1.0) and r.p == pytest.approx(0.317310508)


def test_spline_spans_natural_cubics(spark):
    import numpy as np

    x = [0.0, 1.0, 1.0, 2.0, 3.5, 4.0, 6.0, 7.0, 9.0, 10.0]
    d, names = glm.with_spline(spark.createDataFrame([("g", v) for v in x], "g string, x double"), "x", ["g"])
    rows = {r.x: [1.0, *[r[n] for n in names]] for r in d.collect()}
    knots = np.percentile(sorted(set(x)), [0, 25, 50, 75, 100])
    # the interpolating natural spline through any values at the knots is in the span, so fitted values agree
    b = np.array([[1.0, (k - knots[0]) / 10, *[0.0] * 3] for k in knots])
    for i, k in enumerate((k / 10 for k in knots)):
        c = lambda j: max(k - knots[j] / 10, 0) ** 3  # noqa: B023, E731
        e = [(c(j) - c(4)) / (1 - knots[j] / 10) for j in range(4)]
        b[i, 2:] = [e[j] - e[3] for j in range(3)]
    assert np.linalg.matrix_rank(b) == 5 and rows[0.0][1:] == [0.0] * 4 and rows[10.0][1] == 1.0
    assert rows[10.0] == pytest.approx(b[4])


def test_conditional_odds(spark):
    # With margins of 4 the weights are 1, 16, 36, 16, 1; setting the mean to 3 leaves this quartic.
    t = stats.conditional_odds_value(3, 1, 1, 3)[0]
    assert t > 1 and t**4 - 36 * t**2 - 32 * t - 3 == pytest.approx(0, abs=1e-6)
    assert stats.conditional_odds_value(0, 5, 5, 5)[:2] == (0.0, 0.0) and stats.conditional_odds_value(4, 0, 0, 4)[0] == math.inf and math.isnan(stats.conditional_odds_value(0, 0, 3, 4)[0])
    # by definition: with the odds given, the expected count is the observed one, and each end leaves 2.5 % beyond
    a, b, c, d = 7, 5, 3, 11
    o, low, high = stats.conditional_odds_value(a, b, c, d)
    w = lambda t: [math.comb(12, x) * math.comb(14, 10 - x) * t**x for x in range(11)]
    assert sum(x * v for x, v in enumerate(w(o))) / sum(w(o)) == pytest.approx(7) and sum(w(low)[7:]) / sum(w(low)) == pytest.approx(0.025) and sum(w(high)[:8]) / sum(w(high)) == pytest.approx(0.025)
    got = spark.createDataFrame([(7, 5, 3, 11)], "a long, b long, c long, d long").select(stats.conditional_odds("a", "b", "c", "d").alias("x")).select("x.*").first()
    assert tuple(got) == pytest.approx((o, low, high))


def test_binary_genotypes(spark, tmp_path):
    want = [[random.Random(i * 7 + j).choice([0, 1, 2, None]) for j in range(6)] for i in range(5)]
    code = {2: 0, None: 1, 1: 2, 0: 3}
    body = b"".join(bytes(sum(code[g] << 2 * k for k, g in enumerate(row[at : at + 4])) for at in (0, 4)) for row in want)
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "x.bim").write_text("".join(f"1\tv{i}\t0\t{100 + i}\tA\tG\n" for i in range(5)))
    (tmp_path / "x.fam").write_text("".join(f"f s{j} 0 0 0 -9\n" for j in range(6)))
    d = plink.read_genotypes(spark, f"{tmp_path}/x", rows=2)
    assert {r.variant_id: list(r.dosage) for r in d.collect()} == {f"v{i}": row for i, row in enumerate(want)}
    some = plink.read_genotypes(spark, f"{tmp_path}/x", samples=[5, 0]).where("variant_id = 'v2'").first()
    assert list(some.dosage) == [want[2][5], want[2][0]] and (some.chromosome, some.position, some.a1, some.a2) == ("1", 102, "A", "G")
    for r in plink.allele_frequencies(d).collect():
        seen = [g for g in want[int(r.variant_id[1:])] if g is not None]
        assert r.observed == len(seen) and r.a1_frequency == pytest.approx(sum(seen) / (2 * len(seen)))
    assert [r.sample for r in plink.sample_ids(spark, f"{tmp_path}/x").collect()] == [f"s{j}" for j in range(6)]
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x00" + body)
    with pytest.raises(Exception, match="variant-major"):
        plink.read_genotypes(spark, f"{tmp_path}/x").collect()


def test_ablation(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), i % 2, rng.random()) for i in range(60)]
    d = spark.createDataFrame(rows, "k long, s string, side int, z double")
    got = matching.ablation(d, {"s": (["s"], False), "z": ([], True), "sz": (["s"], True)}, "k", "side", "z", 0.1).collect()
    by = {r[0]: r for r in rows}
    for name in ("s", "z", "sz"):
        m = [r for r in got if r.covariates == name]
        assert m and len({r.treated for r in m}) == len({r.control for r in m}) == len(m)
        assert all(by[r.treated][2] == 1 and by[r.control][2] == 0 and r.gap == pytest.approx(abs(by[r.treated][3] - by[r.control][3])) for r in m)
        assert name == "z" or all(by[r.treated][1] == by[r.control][1] for r in m)
        assert name == "s" or all(r.gap <= 0.1 for r in m)
    n = {s: (sum(r[1] == s and r[2] == 1 for r in rows), sum(r[1] == s and r[2] == 0 for r in rows)) for s in "xy"}
    assert sum(r.covariates == "s" for r in got) == sum(min(v) for v in n.values())


def test_ranged_midranks(spark):
    import random

    from strataframe.operators import ranks

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.0, rng.random()])) for _ in range(900)]
    d = ranks.ranged_midrank(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], "rank", 16)
    for g in "ab":
        values = sorted(x for k, x in rows if k == g)
        want = {x: (2 * values.index(x) + 1 + values.count(x)) / 2 for x in values}
        got = d.where(d.g == g).collect()
        assert len(got) == len(values) and all(r["rank"] == want[r.x] for r in got)


def test_components_and_partition(spark):
    from strataframe.operators import contracts, linkage

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    for parts, bad in (([1, 2, 3], 0), ([1, 2], 1), ([1, 2, 3, 3], 1), ([1, 2, 3, 4], 1)):
        assert contracts.partition(keys, spark.createDataFrame([(x,) for x in parts], "k long"), "p", "k").first().details == bad


def test_text_and_rows(spark):
    from strataframe import storage
    from strataframe.functions import text

    d = spark.createDataFrame([(1, 2, None, 3)], "a_x int, a_y int, b int, old int")
    assert text.merged_suffixes(d).columns == ["b", "old", "a"] and text.renamed(d, {"old": "new", "none": "x"}).columns == ["a_x", "a_y", "b", "new"]
    assert text.renamed(d, {"b": "old"}).first().old == 3 and text.preferred(d, ["old", "zz", "b"]).columns == ["old", "b"] and text.without_empty(d).columns == ["a_x", "a_y", "old"]
    path = storage.fresh(spark, "published")
    for n in (3, 5):  # the second replaces the first
        storage.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert storage.summary(spark.range(4).selectExpr("count(*) z", "max(id) a"), storage.fresh(spark, "summary")).first().asDict() == {"a": 3, "z": 4}
