"""Weighted regression from aggregated moments; only p x p matrices reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def demean(df: DataFrame, columns: list[str], weight: str, group: str) -> DataFrame:
    """Subtract the weighted mean of the group: a fixed effect."""
    w = W.partitionBy(group)
    return df.withColumns({c: F.col(c) - F.sum(F.col(c) * F.col(weight)).over(w) / F.sum(weight).over(w) for c in columns})


def clustered_wls(df: DataFrame, y: str, xs: list[str], weight: str, cluster: str) -> DataFrame:
    """term, estimate, se, t: weighted least squares with a cluster-robust sandwich, factor G/(G-1) * (n-1)/(n-p)."""
    p = len(xs)
    moments = [F.sum(F.col(weight) * F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in [*xs[i:], y]]
    row = df.agg(F.count(F.lit(1)), F.countDistinct(cluster), *moments).first()
    n, g, m = row[0], row[1], list(row[2:])
    a, v = np.zeros((p, p)), np.zeros(p)
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = m.pop(0)
        v[i] = m.pop(0)
    if np.linalg.matrix_rank(a) < p:
        raise ValueError("the design has not full rank")
    bread = np.linalg.inv(a)
    beta = bread @ v
    fit = sum((F.col(x) * float(b) for x, b in zip(xs, beta)), F.lit(0.0))
    scores = df.groupBy(cluster).agg(*[F.sum(F.col(weight) * F.col(x) * (F.col(y) - fit)).alias(f"s{i}") for i, x in enumerate(xs)])
    meat = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p)]).first()
    cov = bread @ np.array(meat, float).reshape(p, p) @ bread * (g / (g - 1)) * ((n - 1) / (n - p))
    se = np.sqrt(np.diag(cov))
    return df.sparkSession.createDataFrame([(x, float(b), float(s), float(b / s)) for x, b, s in zip(xs, beta, se)], "term string, estimate double, se double, t double")


def logistic(df: DataFrame, y: str, xs: list[str], rounds: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """term, estimate: binomial regression by Newton steps whose gradient and Hessian are aggregates. xs should include a constant."""
    p, beta = len(xs), np.zeros(len(xs))
    cached = df.select(y, *xs).persist()
    for _ in range(rounds):
        eta = sum((F.col(x) * float(b) for x, b in zip(xs, beta)), F.lit(0.0))
        d = cached.withColumn("_mu", 1 / (1 + F.exp(-eta)))
        w = F.col("_mu") * (1 - F.col("_mu"))
        row = d.agg(*[F.sum(F.col(x) * (F.col(y) - F.col("_mu"))) for x in xs], *[F.sum(w * F.col(a) * F.col(b)) for a in xs for b in xs]).first()
        step = np.linalg.solve(np.array(row[p:], float).reshape(p, p), np.array(row[:p], float))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    cached.unpersist()
    return df.sparkSession.createDataFrame([(x, float(b)) for x, b in zip(xs, beta)], "term string, estimate double")
