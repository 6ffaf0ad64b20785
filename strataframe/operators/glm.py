"""Logistic regressions of many groups at once: each Newton round is one aggregation over all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.stats import normal_p
from ..storage import materialize


def spline_knots(df: DataFrame, x: str, by: list[str], knots: int = 5) -> DataFrame:
    """(by, _knots): even quantiles of the distinct values, the extremes included."""
    q = F.array(*[F.lit(i / (knots - 1)) for i in range(knots)])
    return df.select(*by, x).distinct().groupBy(*by).agg(F.percentile(x, q).alias("_knots"))


def natural_spline(x: Column, knots: Column, n: int = 5) -> list[Column]:
    """n - 1 columns that with a constant span the natural cubic splines on n knots, x scaled to the knots' range. Only
    the span matters to the other coefficients, so any centring constraint is absorbed by the constant."""
    low, width = F.get(knots, F.lit(0)), F.get(knots, F.lit(n - 1)) - F.get(knots, F.lit(0))
    t = F.try_divide(x - low, width)
    k = [F.try_divide(F.get(knots, F.lit(i)) - low, width) for i in range(n)]
    cube = lambda i: F.pow(F.greatest(t - k[i], F.lit(0.0)), F.lit(3.0))
    d = [F.try_divide(cube(i) - cube(n - 1), k[n - 1] - k[i]) for i in range(n - 1)]
    return [t, *[d[i] - d[n - 2] for i in range(n - 2)]]


def with_spline(df: DataFrame, x: str, by: list[str], knots: int = 5, name: str = "s") -> tuple[DataFrame, list[str]]:
    """Rows with the spline columns of x, knots placed within each group; null x or knots that coincide give nulls."""
    names = [f"{name}{i}" for i in range(knots - 1)]
    cols = natural_spline(F.col(x), F.col("_knots"), knots)
    return df.join(spline_knots(df, x, by, knots), by).withColumns(dict(zip(names, cols))).drop("_knots"), names


def _step(v: np.ndarray, upper: list[tuple[int, int]], p: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(Newton step, inverse Hessian) from the gradient and the upper Hessian; nothing where it is singular."""
    h = np.zeros((p, p))
    for (i, j), x in zip(upper, v[p:]):
        h[i, j] = h[j, i] = x
    try:
        if np.linalg.matrix_rank(h) < p:
            return None, None
        inverse = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return None, None
    return inverse @ v[:p], inverse


def fit(df: DataFrame, by: list[str], y: str, xs: list[str], cluster: str | None = None, rounds: int = 50, tolerance: float = 1e-8, limit: float = 50.0) -> DataFrame:
    """by, term, estimate, se, n, converged. se is a sandwich by cluster with factor G/(G-1), null without cluster.

    Rows with a null in y or xs are left out. A singular or separated fit (a step without solution, or a coefficient past
    limit) has null estimates and converged false. p + p * p sums per group come to the driver each round, so the number
    of groups must be of the size of a parameter grid; rows never do. xs should include a constant."""
    spark, p = df.sparkSession, len(xs)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    data = df.select(*by, y, *xs, *([cluster] if cluster else [])).dropna(subset=[y, *xs]).persist()
    keys = [tuple(r) for r in data.select(*by).distinct().collect()]
    beta, done, failed, bread, sizes = {k: np.zeros(p) for k in keys}, set(), set(), {}, {}
    kind = [data.schema[c] for c in by]
    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kind], "_beta array<double>"])

    def scored(groups: list[tuple]) -> DataFrame:
        b = spark.createDataFrame([(*k, beta[k].tolist()) for k in groups], types)
        eta = sum((F.col(x) * F.get("_beta", F.lit(i)) for i, x in enumerate(xs)), F.lit(0.0))
        return data.join(F.broadcast(b), by).withColumn("_mu", 1 / (1 + F.exp(-eta)))

    try:
        for _ in range(rounds):
            open_ = [k for k in keys if k not in done and k not in failed]
            if not open_:
                break
            w, e = F.col("_mu") * (1 - F.col("_mu")), F.col(y) - F.col("_mu")
            sums = scored(open_).groupBy(*by).agg(F.count(F.lit(1)), *[F.sum(F.col(x) * e).alias(f"g{i}") for i, x in enumerate(xs)], *[F.sum(w * F.col(xs[i]) * F.col(xs[j])).alias(f"h{i}_{j}") for i, j in upper])
            for r in sums.collect():
                k, v = tuple(r[: len(by)]), np.array(r[len(by) + 1 :], float)
                sizes[k] = r[len(by)]
                step, bread[k] = _step(v, upper, p)
                if step is None:
                    failed.add(k)
                    continue
                if np.abs(step).max() < tolerance:
                    done.add(k)  # the Hessian is that of the estimates
                    continue
                beta[k] = beta[k] + step
                if not np.isfinite(beta[k]).all() or np.abs(beta[k]).max() > limit:
                    failed.add(k)
        se = {}
        if cluster and done:
            per = scored(sorted(done, key=str)).groupBy(*by, cluster).agg(*[F.sum(F.col(x) * (F.col(y) - F.col("_mu"))).alias(f"s{i}") for i, x in enumerate(xs)])
            for r in per.groupBy(*by).agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p)]).collect():
                k, g = tuple(r[: len(by)]), r[len(by)]
                if g > 1:
                    cov = bread[k] @ np.array(r[len(by) + 1 :], float).reshape(p, p) @ bread[k] * (g / (g - 1))
                    se[k] = np.sqrt(np.diag(cov))
    finally:
        data.unpersist()
    out = []
    for k in keys:
        ok = k in done
        out += [(*k, x, float(beta[k][i]) if ok else None, float(se[k][i]) if ok and k in se else None, sizes.get(k), ok) for i, x in enumerate(xs)]
    return spark.createDataFrame(out, types.replace("_beta array<double>", "term string, estimate double, se double, n long, converged boolean"))


def contrasts(slopes: DataFrame, by: list[str], group: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """by, contrast, difference, se, z, p, ratio: Wald contrasts of slopes of independent groups (estimate, se)."""
    chosen = F.broadcast(slopes.sparkSession.createDataFrame(list(pairs), "a string, b string"))
    side = lambda s: slopes.select(*by, F.col(group).alias(s), F.col("estimate").alias(f"_e{s}"), F.col("se").alias(f"_s{s}"))
    d = side("a").join(chosen, "a").join(side("b"), [*by, "b"]).withColumns({"difference": F.col("_ea") - F.col("_eb"), "se": F.sqrt(F.col("_sa") * F.col("_sa") + F.col("_sb") * F.col("_sb"))})
    z = F.try_divide(F.col("difference"), F.col("se"))
    return d.select(*by, F.concat("a", F.lit("_minus_"), "b").alias("contrast"), "difference", "se", z.alias("z"), normal_p(z).alias("p"), F.exp("difference").alias("ratio"))


def leave_one_out(df: DataFrame, y: str, xs: list[str], cluster: str, most: int = 10_000, rounds: int = 50, tolerance: float = 1e-8, limit: float = 50.0, at_once: int = 256) -> DataFrame:
    """left_out, term, estimate, se, n, converged: a refit without each cluster that has a positive row; past `most` such
    clusters this raises. Terms as in fit(). Rows are not multiplied: a round reads them once for each `at_once` open fits, whose sums
    are matrix products over a batch of rows. Scores are summed by fit and cluster for the sandwich."""
    spark, p = df.sparkSession, len(xs)
    df = materialize(df.select(y, *[x for x in dict.fromkeys(xs) if x != y], *([cluster] if cluster not in (y, *xs) else [])), "design")
    clusters = sorted(r[0] for r in df.where(F.col(y) == 1).select(cluster).where(F.col(cluster).isNotNull()).distinct().limit(most + 1).collect())
    if len(clusters) > most:
        raise ValueError(f"over {most} clusters to leave out")
    number = spark.createDataFrame(list(enumerate(clusters)), f"_c long, _key {df.schema[cluster].dataType.simpleString()}")
    # Clusters that are never left out are numbered after the others.
    every = df.select(F.col(cluster).alias("_key")).distinct().join(number, "_key", "left_anti").select("_key", (F.row_number().over(W.orderBy("_key")) - 1 + len(clusters)).cast("long").alias("_c"))
    every = materialize(number.select("_key", "_c").unionByName(every), "clusters")
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)], F.col(cluster).alias("_row_key")).dropna(subset=["_y", *[f"_x{i}" for i in range(p)]])
    data = rows.join(F.broadcast(every), F.col("_row_key").eqNullSafe(F.col("_key"))).select("_c", "_y", *[f"_x{i}" for i in range(p)]).persist()
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    beta, sizes, bread, done, failed = np.zeros((len(clusters), p)), np.zeros(len(clusters), np.int64), {}, set(), set()

    def each(batches: Iterator[pa.RecordBatch], fits: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        """(clusters, place of each among the fits or -1, x, residuals, weights) of pieces of rows; the fit without a row's cluster has none of it."""
        place = np.full(len(clusters) + 1, -1)
        place[fits] = np.arange(len(fits))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                t = batch.slice(at, 2048)
                c, v = t.column(0).to_numpy(), np.stack([t.column(i).to_numpy() for i in range(1, p + 2)], 1)
                x = v[:, 1:]
                with np.errstate(over="ignore"):
                    mu = 1 / (1 + np.exp(-(x @ b.T)))
                own = place[np.minimum(c, len(clusters))]
                e, w = v[:, :1] - mu, mu * (1 - mu)
                out = np.flatnonzero(own >= 0)
                e[out, own[out]] = w[out, own[out]] = 0.0
                yield c, own, x, e, w

    def newton(fits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        b = beta[fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(fits), 1 + p + len(upper)))
            for c, own, x, e, w in each(batches, fits, b):
                total[:, 0] += len(c) - np.bincount(own[own >= 0], minlength=len(fits))
                total[:, 1 : p + 1] += e.T @ x
                total[:, p + 1 :] += w.T @ np.stack([x[:, i] * x[:, j] for i, j in upper], 1)
            yield pa.RecordBatch.from_arrays([pa.array(fits), *[pa.array(v) for v in total.T]], names=["f", *[f"v{i}" for i in range(total.shape[1])]])

        n = 1 + p + len(upper)
        for r in data.mapInArrow(run, "f long, " + ", ".join(f"v{i} double" for i in range(n))).groupBy("f").agg(*[F.sum(f"v{i}") for i in range(n)]).collect():
            yield r[0], np.array(r[1:], float)

    def scores(fits: np.ndarray) -> Iterator[tuple]:
        b, flush = beta[fits], max(1, (1 << 23) // max(1, len(fits) * p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def packed(sums: dict) -> pa.RecordBatch:
                c = np.array(list(sums), np.int64)
                v = np.stack(list(sums.values())).reshape(-1, p)
                return pa.RecordBatch.from_arrays([pa.array(np.tile(fits, len(c))), pa.array(np.repeat(c, len(fits))), *[pa.array(x) for x in v.T]], names=["f", "c", *[f"s{i}" for i in range(p)]])

            sums: dict[int, np.ndarray] = {}
            for c, _, x, e, _ in each(batches, fits, b):
                order = np.argsort(c, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
                    k = int(c[at[0]])
                    sums[k] = sums.get(k, 0) + e[at].T @ x[at]
                if len(sums) > flush:
                    yield packed(sums)
                    sums = {}
            if sums:
                yield packed(sums)

        per = data.mapInArrow(run, "f long, c long, " + ", ".join(f"s{i} double" for i in range(p))).where("f <> c").groupBy("f", "c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)])
        return per.groupBy("f").agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p)]).collect()

    se = {}
    try:
        for _ in range(rounds):
            open_ = np.array([k for k in range(len(clusters)) if k not in done and k not in failed], np.int64)
            for at in range(0, len(open_), at_once):
                for k, v in newton(open_[at : at + at_once]):
                    sizes[k] = int(v[0])
                    if not sizes[k]:
                        failed.add(k)
                        continue
                    step, bread[k] = _step(v[1:], upper, p)
                    if step is None:
                        failed.add(k)
                    elif np.abs(step).max() < tolerance:
                        done.add(k)
                    else:
                        beta[k] = beta[k] + step
                        if not np.isfinite(beta[k]).all() or np.abs(beta[k]).max() > limit:
                            failed.add(k)
            if not len(open_):
                break
        last = np.array(sorted(done), np.int64)
        for at in range(0, len(last), at_once):
            for r in scores(last[at : at + at_once]):
                if r[1] > 1:
                    se[r[0]] = np.sqrt(np.diag(bread[r[0]] @ np.array(r[2:], float).reshape(p, p) @ bread[r[0]] * (r[1] / (r[1] - 1))))
    finally:
        data.unpersist()
    out = [(c, x, float(beta[k][i]) if k in done else None, float(se[k][i]) if k in se else None, int(sizes[k]), k in done) for k, c in enumerate(clusters) for i, x in enumerate(xs) if sizes[k]]
    return spark.createDataFrame(out, f"left_out {df.schema[cluster].dataType.simpleString()}, term string, estimate double, se double, n long, converged boolean")


def cross_validated(df: DataFrame, by: list[str], y: str, xs: list[str], cluster: str, folds: int = 5, seed: int = 3, least: int = 5, name: str = "predicted") -> DataFrame:
    """The rows with the probability predicted by a fit on the other folds; a cluster lies in one fold, by hash. Null where
    the training rows have fewer than least positives, the fit fails, or a predictor is missing."""
    d = df.withColumn("_fold", draw(F.concat_ws("|", F.lit(seed), F.col(cluster).cast("string")), F.lit(folds)))
    train = d.withColumn("_test", F.explode(F.sequence(F.lit(1), F.lit(folds)))).where(F.col("_test") != F.col("_fold")).withColumn("_test", F.col("_test").cast("long"))
    keys = [*by, "_test"]
    enough = train.groupBy(*keys).agg(F.sum(y).alias("_n")).where(F.col("_n") >= least).select(*keys)
    b = fit(train.join(F.broadcast(enough), keys, "left_semi"), keys, y, xs)
    wide = b.where("converged").groupBy(*keys).pivot("term", xs).agg(F.first("estimate"))
    wide = wide.select(*by, F.col("_test").alias("_fold"), *[F.col(f"`{x}`").alias(f"_b{i}") for i, x in enumerate(xs)])
    eta = sum((F.col(x) * F.col(f"_b{i}") for i, x in enumerate(xs)), F.lit(0.0))
    return d.withColumn("_fold", F.col("_fold").cast("long")).join(F.broadcast(wide), [*by, "_fold"], "left").withColumn(name, 1 / (1 + F.exp(-eta))).drop("_fold", *[f"_b{i}" for i in range(len(xs))])
