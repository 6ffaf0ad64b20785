"""Operators that must not list, hold or multiply all their rows, against brute force on small tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataframe.operators import linkage


def vectors_and_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3), [float(v) for v in rng.normal(size=6)]) for i in range(90)]
    rows += [(90, 0, rows[0][2]), (91, 0, [1.0] * 6), (92, 0, None), (93, 0, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    pairs = {}
    for a, g, x in rows:
        for b, h, y in rows:
            if a < b and g == h:
                ok = all(v is not None and None not in v and len(set(v)) > 1 for v in (x, y))
                pairs[g, a, b] = float(np.corrcoef(x, y)[0, 1] ** 2) if ok else None
    return spark.createDataFrame(rows, "k long, g int, v array<float>"), pairs


def test_links_within_reach(spark):
    d, pairs = vectors_and_pairs(spark)
    for reach in (None, 7):
        got = {(r.a, r.b): r.r2 for r in linkage.pair_links(d, "g", "k", "v", 0.3, reach).collect()}
        want = {(a, b): x for (_, a, b), x in pairs.items() if x is not None and x >= 0.3 and (reach is None or b - a <= reach)}
        assert got == pytest.approx(want, abs=1e-6) and want


def test_degrees_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    d, pairs = vectors_and_pairs(spark)
    want = {}
    for (_, a, b), x in pairs.items():
        if x is not None and x >= 0.3:
            want.setdefault(a, []).append(x), want.setdefault(b, []).append(x)
    got = {r.a: r for r in linkage.pair_degrees(d, "g", "k", "v", 0.3).collect()}
    assert got.keys() == want.keys()
    for a, x in want.items():
        assert (got[a].neighbours, got[a].over_50) == (len(x), sum(v >= 0.5 for v in x)) and got[a].score == pytest.approx(1 + sum(x), abs=1e-6) and got[a].strongest == pytest.approx(max(x), abs=1e-6)


def test_pair_summary_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    d, pairs = vectors_and_pairs(spark)
    got = {r.g: r for r in linkage.pair_summary(d, "g", "k", "v").collect()}
    for g in range(3):
        x = [v for (h, _, _), v in pairs.items() if g == h]
        some = [v for v in x if v is not None]
        assert got[g].pairs == len(x) and got[g]["mean"] == pytest.approx(sum(some) / len(some), abs=1e-6) and got[g].top == pytest.approx(max(some), abs=1e-6)


def test_clumps_of_vectors(spark):
    d, pairs = vectors_and_pairs(spark)
    rng = random.Random(1)
    nodes = d.withColumn("p", F.element_at(F.array(*[F.lit(rng.choice([1.0, 2.0, rng.random()])) for _ in range(94)]), (F.col("k") + 1).cast("int")))
    edges = spark.createDataFrame([(a, b, x) for (_, a, b), x in pairs.items() if x is not None], "a long, b long, r2 double")
    want = {(r.g, r.k): (r["index"], round(r.r2, 6)) for r in linkage.clump(nodes, edges, "g", "k", "p", 0.3).collect()}
    got = {(r.g, r.k): (r["index"], round(r.r2, 6)) for r in linkage.clump_vectors(nodes, "g", "k", "p", "v", 0.3, 4).collect()}
    assert got == want and len(got) == 94


def plain_matches(rows, calipers, k):
    """(key, gene, positive, hash, covariates) -> {positive: controls}, with all candidates listed."""
    near = {p[0]: [c for c in rows if not c[2] and all(abs(x - y) <= z for x, y, z in zip(p[4], c[4], calipers))] for p in rows if p[2]}
    used, out = set(), {}
    for p in sorted((r for r in rows if r[2]), key=lambda r: (len(near[r[0]]), r[3], r[0])):
        c = sorted(near[p[0]], key=lambda c: (2 * (c[0] in used) + (c[1] != p[1]), c[3], c[0]))[:k]
        out[p[0]] = [(c[0], c[1] == p[1], c[0] in used) for c in c]
        used |= {c[0] for c in c}
    return out


def test_matching_against_listed_candidates(spark):
    import hashlib

    from strataframe.operators import matching

    rng = random.Random(8)
    draw = {"few": lambda: (rng.choice([0.0, 0.5, 1.0, 1.6]), rng.choice([0.1, 0.2, 0.3])), "any": lambda: (rng.random() * 4, rng.random())}
    rows = [(s, f"{s}{i}", rng.choice([1, 2, 3]), rng.random() < 0.3, *f()) for s, f in draw.items() for i in range(150)]
    d = spark.createDataFrame(rows, "s string, k string, g int, p boolean, x double, y double")
    got = {}
    for r in matching.matched_controls(d, ["s"], "k", "g", "p", {"x": 0.7, "y": 0.1}, 4).orderBy("rank").collect():
        got.setdefault(r.positive, []).append((r.control, r.same_gene, r.reused))
    want = {}
    for s in draw:
        want |= plain_matches([(k, g, p, hashlib.sha256(f"42|{k}".encode()).digest()[:4], (x, y)) for t, k, g, p, x, y in rows if s == t], (0.7, 0.1), 4)
    assert got == {p: c for p, c in want.items() if c} and any(r for c in got.values() for _, _, r in c)


def test_matching_lists_no_candidates():
    import tracemalloc

    import numpy as np

    from strataframe.operators import matching

    genes = np.arange(20_000) % 50
    tracemalloc.start()
    n = sum(len(c) for _, c, _, _ in matching.match_stratum(np.ones((3000, 1)), np.ones((20_000, 1)), genes[:3000], genes, np.array([0.5]), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 15_000 and peak < 30e6  # listed candidates would take 480 MB


def test_leave_one_out_multiplies_no_rows(spark, monkeypatch):
    """Against fits of the rows multiplied by hand, with a cluster that is never left out, one without a name and a singular fit."""
    from strataframe.operators import glm

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + 2.7 ** (x - 0.3)))) for _ in range(200)] + [("z", 0.5, 0.0), ("y", None, 1.0)]
    d = spark.createDataFrame(rows, "c string, x double, y double").withColumn("one", F.lit(1.0))
    clusters = ["a", "b", "c", "y"]
    many = d.withColumn("left_out", F.explode(F.array_except(F.array(*map(F.lit, clusters)), F.array("c"))))
    want = {(r.left_out, r.term): r for r in glm.fit(many, ["left_out"], "y", ["one", "x"], "c").collect()}
    exploded = []
    monkeypatch.setattr(glm.F, "explode", lambda *a: exploded.append(a))
    got = {(r.left_out, r.term): r for r in glm.leave_one_out(d, "y", ["one", "x"], "c", at_once=3).collect()}
    assert got.keys() == want.keys() and len(got) == 8 and not exploded
    for k, w in want.items():
        assert (got[k].n, got[k].converged) == (w.n, w.converged) and got[k].estimate == pytest.approx(w.estimate, abs=1e-9) and got[k].se == pytest.approx(w.se, abs=1e-9)


def test_draws_are_made_in_place(spark):
    import hashlib

    from strataframe.operators import auroc

    rng = random.Random(6)
    rows = [(g, f"{g}{i}", rng.random() < 0.4, float(rng.randint(0, 3)), rng.choice([0.0, 1.0, rng.random()])) for g in "ab" for i in range(60)]
    d = spark.createDataFrame(rows, "g string, k string, p boolean, x double, score double")
    frame = auroc.balanced_draws(d, F.col("p"), "x", ["g"], "k", 7, 42)
    assert "explode" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r.g, r.replicate): r.auroc for r in frame.collect()}
    bins = {(r.g, r.k): r.bin for r in auroc.decile_bins(d, "x", ["g"]).collect()}
    for g in "ab":
        pos, neg = ([(k, bins[g, k], s) for h, k, p, _, s in rows if h == g and p == side] for side in (True, False))
        of = {b: sorted((k, s) for k, c, s in neg if c == b) for b in bins.values()}
        pos = [p for p in pos if of[p[1]]]
        for rep in range(1, 8):
            drawn = [of[b][int.from_bytes(hashlib.sha256(f"42|{g}|{b}|{rep}|{k}".encode()).digest()[:4], "big") % len(of[b])][1] for k, b, _ in pos]
            assert got[g, rep] == pytest.approx(sum((s > n) + (s == n) / 2 for n in drawn for _, _, s in pos) / len(pos) ** 2)
    assert len(got) == 14


def test_gates_read_pairs_once(spark):
    from strataframe import registry

    plan = registry.QUERIES["gates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "row_number" not in plan


def test_cube_repeats_no_rows(spark, monkeypatch):
    import numpy as np

    from strataframe.operators import cubes

    def midranks(v):
        _, of, n = np.unique(np.array(v) + 0.0, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[of]

    rng = random.Random(12)
    few = lambda: rng.choice([0.0, -0.0, 1.0, rng.random(), rng.gauss(0, 9)])
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), few(), few()) for _ in range(1500)] + [("a", "x", None, 1.0)]
    stored = []
    monkeypatch.setattr(cubes, "materialize", lambda d, label: stored.append(d) or d)
    got = {(r.g1, r.g2): r for r in cubes.concordance(spark.createDataFrame(rows, "a string, b string, x double, y double"), "a", "b", "x", "y").collect()}
    assert [d.count() for d in stored] == [1500]
    want = {(g, h): [(x, y) for a, b, x, y in rows if x is not None and g in ("All", a) and h in ("All", b)] for g in ("All", "a", "b") for h in ("All", "x", "y")}
    assert got.keys() == want.keys()
    for k, xy in want.items():
        assert got[k].n == len(xy) and got[k].spearman == pytest.approx(np.corrcoef(*map(midranks, zip(*xy)))[0, 1], abs=1e-9)


def test_pairs_move_once(spark, tmp_path):
    """Keys with nulls as the SQL's joined text has them; filters on the key come before rows move."""
    import duckdb

    from strataframe.plans import base

    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    keys = [(5, 1, 7, 1), (5, 1, 7, 1), (5, 1, None, 7), (None, 7, 1, 5), (5, None, 7, 1), (6, 2, 3, 4), (6, 2, 3, 4), (None, None, None, None), (6, 9, None, None)]
    spark.createDataFrame([(*k, 10.0 + i, 50.0 - i, 0.0, 0.0, "ANR"[i % 3], "O", datetime(2000, 1, 1 + i)) for i, k in enumerate(keys)], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, datetime(1999, 12, 1)) for k in (5, 6, None)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    sql = base.SCORED.replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'").replace("JOIN orders", f"JOIN '{tmp_path}/orders.parquet/*.parquet'")
    want = duckdb.sql(sql + "SELECT pair_key, ancestry, maf, pip FROM scored").fetchall()
    d = base.scored(spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(d.select("pair_key", "ancestry", "maf", "pip").collect()) == order(want) and len(want) == 4
    plan = d.where("pip >= 0.5")._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "POWER" in x.upper() for x in plan[plan.index("Window ") :].splitlines())


def plain_nearest(rows, caliper):
    """(key, side, value) -> pairs, with all free rows listed."""
    free, out = [r for r in rows if not r[1]], set()
    for k, _, v in sorted((r for r in rows if r[1]), key=lambda r: (-r[2], r[0])):
        # Below before above at equal gaps; of equal values the largest key below, the smallest above.
        under = max(((x, c) for c, _, x in free if x < v), default=None)
        over = min(((x, c) for c, _, x in free if x >= v), default=None)
        best = over if under is None or over is not None and over[0] - v < v - under[0] else under
        if best is not None and abs(best[0] - v) <= caliper:
            out.add((k, best[1]))
            free = [r for r in free if r[0] != best[1]]
    return out


def test_nearest_pairs_stream(spark, monkeypatch):
    from strataframe.operators import matching

    rng = random.Random(9)
    draw = {"few": lambda: rng.randint(0, 12) / 8, "any": rng.random, "sparse": lambda: 40 * rng.random(), None: rng.random}
    rows = [(s, f"{s}{i:03}", int(rng.random() < share), f(), rng.choice(["u", "w", None])) for n, (s, f) in enumerate(draw.items()) for i, share in enumerate([(0.5, 0.2, 0.7, 0.4)[n]] * 200)]
    rows += [("any", "none", 1, None, "u"), ("any", "nan", 0, float("nan"), "u")]
    d = spark.createDataFrame(rows, "s string, k string, side int, v double, more string").repartition(5)
    want = {s: plain_nearest([(k, t, v) for x, k, t, v, _ in rows if x == s and v is not None and v == v], 0.125) for s in draw}
    more = {r[1]: r[4] for r in rows}
    got = {s: set() for s in draw}
    for r in matching.nearest_pairs(d, ["s"], "k", "side", "v", 0.125, ["more"]).collect():
        got[r.s].add((r.treated, r.control))
        assert (r.more_treated, r.more_control) == (more[r.treated], more[r.control])
    assert got == want and all(want.values())
    stored = []
    monkeypatch.setattr(matching, "materialize", lambda d, label: stored.append(label) or d)
    out = matching.ablation(d, {"s": (["s"], False), "z": ([], True), "sz": (["s"], True)}, "k", "side", "v", 0.125, ["more"])
    pairs = {n: {(r.treated, r.control) for r in out.where(F.col("covariates") == n).collect()} for n in ("z", "sz")}
    assert stored == ["ablation"] and pairs["sz"] == set().union(*want.values())
    assert pairs["z"] == plain_nearest([(k, t, v) for _, k, t, v, _ in rows if v is not None and v == v], 0.125)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan


def test_nearest_holds_rows_in_reach():
    from strataframe.operators import matching

    m, most = matching.Nearest(0.01), 0
    for i in range(100_000):
        m.add(1 - i / 100_000, i % 3 == 0, (i,))
        most = max(most, len(m.over) + len(m.waiting))
    assert most < 1100 and len(m.end()) == 33_334


def test_medians(spark):
    import statistics

    from strataframe.operators import ranks

    rng = random.Random(5)
    of = {"one": [2.0], "two": [1.0, 4.0], "same": [3.0] * 50, "many": [rng.random() for _ in range(3001)], "even": [rng.choice([0.0, 1.0, rng.random()]) for _ in range(4000)]}
    d = spark.createDataFrame([(g, x) for g, v in of.items() for x in [*v, None]], "g string, x double")
    assert {r.g: r.m for r in ranks.median(d, ["g"], "x", "m").collect()} == pytest.approx({g: statistics.median(v) for g, v in of.items()})


def test_balanced_grid_repeats_no_rows(spark, monkeypatch):
    """Against the draws of each score and cell alone; with ties, a missing distance, bins without negatives and an empty cell."""
    from strataframe.operators import auroc

    rng = random.Random(9)
    rows = [(g, f"{g}{i:03d}", rng.random(), rng.choice([None, 0.0, 1.0, 2.0, rng.random() * 3]), rng.choice([0.0, 1.0, rng.random()]), rng.random()) for g in "ab" for i in range(90)]
    rows += [("a", f"z{i}", 0.95, 50.0, rng.random(), 0.5) for i in range(30)] + [("a", "none", None, 1.0, 0.1, 0.1)]
    d = spark.createDataFrame(rows, "g string, k string, v double, x double, one double, two double")
    v = F.col("v")
    cells = {(0.5, "low"): (v >= 0.5, v < 0.2), (0.8, "rest"): (v >= 0.8, (v >= 0.2) & (v < 0.8)), (2.0, "rest"): (v >= 2, v < 0.5)}
    want = {}
    for i, ((t, m), (pos, neg)) in enumerate(cells.items()):
        for s in ("one", "two"):
            c = d.where(pos | neg).select("g", "k", "v", "x", F.col(s).alias("score"), F.lit(s).alias("tool"), F.lit(t).alias("t"), F.lit(m).alias("m"))
            want |= {(r.g, s, i, r.replicate): r.auroc for r in auroc.balanced_draws(c, pos, "x", ["g", "tool", "t", "m"], "k", 5).collect()}
    exploded = []
    monkeypatch.setattr(auroc.F, "explode", lambda *a: exploded.append(a))
    monkeypatch.setattr(auroc, "materialize", lambda df, *a: df if exploded.append(df.count()) is None else df)
    got = {(r.g, r.score, r.cell, r.replicate): r.auroc for r in auroc.balanced_grid(d, cells, "x", ["g"], "k", ["one", "two"], 5, rows=50).collect()}
    assert got.keys() == want.keys() and len(got) == 40 and all(got[k] == pytest.approx(w, abs=1e-12) for k, w in want.items())
    assert exploded == [len([r for r in rows if r[2] is not None])]  # rows are stored once


def plain_pool(rows, calipers, scales, k, pool, key):
    """Rows of (key, gene, positive, covariates) of one stratum -> {positive: controls}, with all candidates listed and sorted."""
    import hashlib

    import numpy as np

    rng = np.random.RandomState(np.frombuffer(hashlib.sha256(key.encode()).digest(), ">u4").astype(np.uint32))
    rows = sorted(rows)
    near = {}
    for p in (r for r in rows if r[2]):
        gaps = [(c, [abs(a - b) for a, b in zip(c[3], p[3])]) for c in rows if not c[2] and None not in c[3]]
        near[p[0]] = [c for _, _, c in sorted((sum(g / s for g, s in zip(gap, scales)), c[0], c) for c, gap in gaps if all(g <= z for g, z in zip(gap, calipers)))]
    of, races, used, out = {r[0]: r for r in rows}, [], set(), {}
    uniform = dict(zip(near, rng.random_sample(len(near))))

    def pick(found, n):
        nonlocal races
        found = found[: max(pool, n)]
        if len(found) <= n:
            return found
        if len(races) < len(found):
            races = (-np.log1p(-rng.random_sample(1 << 14))).tolist()
        return [c for _, c in sorted((races.pop() * (i + 1.0) ** 2, c) for i, c in enumerate(found))[:n]]

    for p in sorted(near, key=lambda p: (len(near[p]), uniform[p])):
        all_, chosen = [c[0] for c in near[p]], []
        same = [c for c in all_ if of[c][1] == of[p][1]]
        for candidates, again in ((same, False), (all_, False), (same, True), (all_, True)):
            if len(chosen) < k:
                chosen = chosen + pick([c for c in candidates if c not in chosen and (again or c not in used)], k - len(chosen))
        out[p] = [(c, of[c][1] == of[p][1], c in used) for c in chosen]
        used |= set(chosen)
    return out


def test_nearest_pool_against_listed_candidates(spark):
    from strataframe.operators import matching

    rng = random.Random(12)
    draw = {"few": lambda: (rng.choice([0.0, 0.5, 1.0, 1.75]), rng.choice([0.25, 0.5, None])), "any": lambda: (rng.random() * 4, rng.random())}
    rows = [(s, f"{s}{i}", rng.choice([1, 2, 3]), rng.random() < 0.25, *f()) for s, f in draw.items() for i in range(160)]
    rows = [r if not r[3] or r[5] is not None else (*r[:5], 0.5) for r in rows]
    d = spark.createDataFrame([*rows, (None, "lost", 1, True, 1.0, 0.5)], "s string, k string, g int, p boolean, x double, y double")
    got, want = {}, {}
    for r in matching.nearest_pool_controls(d, ["s"], "k", "g", "p", {"x": (0.75, 0.2), "y": (0.25, 0.02)}, 4, 6, 5, at_once=2, batch=8).orderBy("rank").collect():
        got.setdefault((r.iteration, r.positive), []).append((r.control, r.same_gene, r.reused))
    for s in draw:
        for i in range(5):
            own = [(k, g, p, (x, y)) for t, k, g, p, x, y in rows if t == s]
            want |= {(i, p): c for p, c in plain_pool(own, (0.75, 0.25), (0.2, 0.02), 4, 6, f"42|{i}|{s}").items() if c}
    assert got == want and any(r for c in got.values() for _, _, r in c)
    assert got != {(i, p): got[0, p] for i, p in got}  # iterations differ


def test_nearest_pool_weights_and_query(spark):
    """The nearest of twelve is drawn with 1 / (1 + 1/4 + ... + 1/144), the thirteenth never; the query makes all iterations of ten."""
    import numpy as np

    from strataframe import registry
    from strataframe.operators import matching

    con = np.arange(1, 21)[:, None] / 100.0
    m = matching.NearestPool(np.zeros((1, 1)), con, np.array([0]), np.full(20, 1), np.array([1.0]), np.array([0.1]), 1, 12)
    drawn = np.bincount([c[0] for i in range(4000) for _, c, _, _ in m.iteration(f"x|{i}")], minlength=20) / 4000
    want = 1 / np.arange(1, 13) ** 2.0
    assert not drawn[12:].any() and np.abs(drawn[:12] - want / want.sum()).max() < 0.03
    r = registry.QUERIES["control_matching"](spark, "/root/testdata/sf0.001").selectExpr("count(distinct iteration) n", "max(rank) m", "min(iteration) a", "max(iteration) z").first()
    assert (r.n, r.m, r.a, r.z) == (100, 10, 0, 99)
