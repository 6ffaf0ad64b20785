"""Area under the ROC curve: midranks, weights, distance-balanced resampling, cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hashing import draw
from ..storage import materialize, swept
from .ranks import UP


def superiority(df: DataFrame, value: str, top: Column, weight: Column, by: list[str], name: str = "auroc") -> DataFrame:
    """P(top > rest) + P(equal) / 2 by weight. Rows are summed by distinct value before the window, so ties cost nothing."""
    d = df.groupBy(*by, value).agg(F.sum(F.when(top, weight).otherwise(0.0)).alias("_t"), F.sum(F.when(~top, weight).otherwise(0.0)).alias("_r"))
    below = F.sum("_r").over(W.partitionBy(*by).orderBy(value).rowsBetween(*UP)) - F.col("_r")
    d = d.withColumn("_b", below).groupBy(*by).agg(F.sum(F.col("_t") * (F.col("_b") + F.col("_r") / 2)).alias("_s"), F.sum("_t").alias("_tt"), F.sum("_r").alias("_rr"))
    return d.select(*by, F.when((F.col("_tt") > 0) & (F.col("_rr") > 0), F.col("_s") / (F.col("_tt") * F.col("_rr"))).alias(name))


def auroc(df: DataFrame, score: str, positive: Column, by: list[str], name: str = "auroc") -> DataFrame:
    return superiority(df, score, positive, F.lit(1.0), by, name)


def decile_bins(df: DataFrame, x: str, by: list[str], n: int = 10, name: str = "bin") -> DataFrame:
    """Right-closed bins between distinct quantiles of the pooled rows; the least value is in the first bin."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)]))).alias("_edges"))
    d = df.join(edges, by)
    inner = F.filter("_edges", lambda e: e < F.col(x))
    return d.withColumn(name, F.greatest(F.lit(1), F.size(inner))).drop("_edges")


def balanced_draws(df: DataFrame, positive: Column, x: str, by: list[str], key: str, replicates: int, seed: int = 42, score: str = "score") -> DataFrame:
    """(by, replicate, auroc): positives of each bin against as many negatives drawn with replacement from the same bin; bins
    without negatives drop out with their positives. Since all replicates have the same positives, an AUROC is the mean
    over its draws of the share of positives above the negative, which each negative gets once; no replicate is ranked. Negatives are
    numbered once per bin; a draw is a hash of seed, cell, replicate and positive. One task makes a cell's draws, next to the
    shares of its negatives, and only sums leave it: draws are never rows."""
    cell = [*by, "bin"]
    d = materialize(decile_bins(df.withColumn("_pos", positive), x, by).select(*cell, "_pos", key, score), "bins")
    sizes = d.where(~F.col("_pos")).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, cell)
    values = d.groupBy(*by, score).agg(F.count_if(F.col("_pos")).alias("_p"))
    above = F.sum("_p").over(W.partitionBy(*by)) - F.sum("_p").over(W.partitionBy(*by).orderBy(score).rowsBetween(*UP))
    share = values.select(*by, F.col(score).alias("_s"), F.try_divide(above + F.col("_p") / 2.0, F.sum("_p").over(W.partitionBy(*by))).alias("_g"))
    side = lambda rows, suffix, i, g: rows.select(*by, F.col("bin").cast("string").alias("_bin"), F.concat_ws("|", F.lit(seed), *by, F.col("bin")).alias("_prefix"), suffix.alias("_suffix"), i.cast("long").alias("_i"), g.cast("double").alias("_g"))
    negative = d.where(~F.col("_pos")).withColumn("_i", F.row_number().over(W.partitionBy(*cell).orderBy(key))).withColumnRenamed(score, "_s").join(share, [*by, "_s"])
    positive_ = side(d.where("_pos"), F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")), F.col("_n"), F.lit(None))
    both = positive_.unionByName(side(negative, F.lit(None).cast("string"), F.col("_i"), F.col("_g")))
    kinds = [(c, d.schema[c].dataType) for c in by]
    out = pa.schema([*[(c, to_arrow_type(k)) for c, k in kinds], ("replicate", pa.int32()), ("s", pa.float64()), ("c", pa.int64())])

    def draws(t: pa.Table) -> pa.Table:
        """Sums over the draws of one cell, which are made and looked up in place."""
        prefix, chosen = t.column("_prefix")[0].as_py(), t.column("_suffix").is_valid()
        pos, neg = t.filter(chosen), t.filter(pa.compute.invert(chosen))
        if not len(pos):
            return out.empty_table()
        share_of = np.full(pos.column("_i")[0].as_py(), np.nan)
        share_of[neg.column("_i").to_numpy() - 1] = neg.column("_g").to_numpy()
        s, c = np.zeros(replicates), np.zeros(replicates, np.int64)
        for at in range(0, len(pos), 1 << 16):
            suffixes = [x.encode() for x in pos.column("_suffix").slice(at, 1 << 16).to_pylist()]
            for i in range(replicates):
                p = f"{prefix}|{i + 1}".encode()
                h = np.frombuffer(b"".join([sha256(p + x).digest()[:4] for x in suffixes]), ">u4").astype(np.int64)
                g = share_of[h % len(share_of)]
                g = g[~np.isnan(g)]
                s[i] += g.sum()
                c[i] += len(g)
        return pa.table([*[pa.array([t.column(k)[0].as_py()] * replicates, f.type) for k, f in zip(by, out)], pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(s), pa.array(c)], schema=out)

    types = ", ".join(f"`{c}` {k.simpleString()}" for c, k in kinds)
    sums = both.groupBy(*by, "_bin").applyInArrow(draws, f"{types}, replicate int, s double, c long").where("c > 0")
    return sums.groupBy(*by, "replicate").agg((F.sum("s") / F.sum("c")).alias("auroc"))


def spread(each: DataFrame, by: list[str], least: int) -> DataFrame:
    """Mean, deviation and percentiles of the replicates of groups with at least so many."""
    return each.where("auroc is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("sd"), F.percentile("auroc", F.lit(0.025)).alias("low"), F.percentile("auroc", F.lit(0.975)).alias("high")).where(F.col("draws") >= least)


def bootstrap_auroc(df: DataFrame, positive: Column, x: str, by: list[str], key: str, replicates: int = 100, least: int = 10, seed: int = 42, score: str = "score") -> DataFrame:
    return spread(balanced_draws(df, positive, x, by, key, replicates, seed, score), by, least)


def _packed(**columns: pa.Array | np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def balanced_grid(df: DataFrame, cells: dict[tuple, tuple[Column, Column]], x: str, by: list[str], key: str, scores: list[str], replicates: int, seed: int = 42, n: int = 10, rows: int = 1 << 18) -> DataFrame:
    """(by, score, cell, replicate, auroc): balanced_draws for every score and every cell of a grid, whose values name it in the
    draws' hashes and give its positives and negatives. No row is repeated per score or cell: rows are stored once with two
    bit masks of the cells they serve (at most 63), and sent to a task per group and number of a bin, so a row moves again only where the
    cells' bins differ. Each task also gets all positives' scores of its group, as packed columns. Scores are null together; key is text."""
    spark, at, bits = df.sparkSession, list(range(len(cells))), np.min_scalar_type(1 << len(cells))
    mask = lambda side: sum((F.when(sides[side], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, sides in enumerate(cells.values())), F.lit(0).cast("long"))
    d = df.dropna(subset=[*by, *scores]).select(*by, F.col(key).cast("string").alias("_k"), F.col(x).cast("double").alias("_x"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(scores)], mask(0).alias("_pos"), mask(1).alias("_neg"))
    with swept(spark):
        d = materialize(d.where("(_pos | _neg) <> 0"), "grid", "zstd")
    count = lambda of, name: [F.count_if(F.expr(f"({of}) & {1 << i}L") != 0).alias(f"{name}{i}") for i in at]
    counts = d.groupBy(*by, "_x").agg(*count("_pos | _neg", "_m"), *count("_neg", "_n"))
    points = F.array(*[F.lit(i / n) for i in range(n + 1)])
    found = counts.groupBy(*by).agg(*[F.array_distinct(F.percentile("_x", points, F.col(f"_m{i}"))).alias(f"_e{i}") for i in at]).collect()
    groups = spark.createDataFrame([(*r[: len(by)], g) for g, r in enumerate(found)], ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "_g int"]))
    edges = [[np.array(r[f"_e{i}"] or [], float) for i in at] for r in found]

    def bins(v: np.ndarray, null: np.ndarray, g: int, i: int) -> np.ndarray:
        """As decile_bins gives them; without a value the first."""
        return np.where(null, 1, np.maximum(1, np.searchsorted(edges[g][i], v)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, null, v = b.column(0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False), b.column(1).fill_null(0).to_numpy()
            for one in np.unique(g):
                own = np.flatnonzero(g == one)
                sums = np.concatenate([np.bincount(bins(v[own], null[own], one, i), b.column(2 + i).to_numpy()[own], n + 2) for i in at])
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), one, np.int32)), pa.array(some // (n + 2)), pa.array(some % (n + 2)), pa.array(sums[some].astype(np.int64))], names=["g", "cell", "bin", "n"])

    held = counts.join(F.broadcast(groups), by).select("_g", "_x", *[f"_n{i}" for i in at]).mapInArrow(sizes, "g int, cell long, bin long, n long").groupBy("g", "cell", "bin").agg(F.sum("n").alias("n")).collect()
    # Bins with negatives, as bits of cells; a task for each number of a bin that some cell of the group has.
    filled = np.zeros((len(found), len(at), n + 2), bool)
    for r in held:
        filled[r.g, r.cell, r.bin] = True
    tasks = [(g, b) for g in range(len(found)) for b in range(1, n + 1) if filled[g, :, b].any()]
    number = {t: i for i, t in enumerate(tasks)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            group, k = t.column("_g").to_numpy(), t.column("_k").combine_chunks()
            null, v = t.column("_x").is_null().to_numpy(), t.column("_x").fill_null(0).to_numpy()
            pos, neg = t.column("_pos").to_numpy(), t.column("_neg").to_numpy()
            values = [t.column(f"_s{i}").to_numpy() for i in range(len(scores))]
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                of = [bins(v[own], null[own], g, i) for i in at]
                use = sum(filled[g, i, of[i]].astype(np.int64) << i for i in at)
                p = np.flatnonzero(pos[own] & use)
                p = p[np.argsort(values[0][own[p]])]
                every = _packed(pos=(pos[own] & use)[p].astype(bits), **{f"s{i}": x[own[p]] for i, x in enumerate(values)})
                for b in (b for h, b in tasks if h == g):
                    here = sum((of[i] == b).astype(np.int64) << i for i in at) & use
                    here_pos, here_neg = pos[own] & here, neg[own] & here
                    some = np.flatnonzero(here_pos | here_neg)
                    r = own[some]
                    data = _packed(k=k.take(pa.array(r)), pos=here_pos[some].astype(bits), neg=here_neg[some].astype(bits), **{f"s{i}": x[r] for i, x in enumerate(values)})
                    yield pa.RecordBatch.from_arrays([pa.array([number[g, b]] * 2, pa.int32()), pa.array([False, True]), pa.array([data, every], pa.binary())], names=["to", "every", "data"])

        parts, m = [], 0
        for b in batches:
            parts.append(b)
            m += b.num_rows
            if m >= rows:
                yield from out(pa.Table.from_batches(parts))
                parts, m = [], 0
        if m:
            yield from out(pa.Table.from_batches(parts))

    names = ["|".join(map(str, cell)) for cell in cells]
    group_names = [[str(v) for v in r[: len(by)]] for r in found]

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the draws of a group's bins of one number, which are made and looked up in place."""
        to, parts = None, {False: [], True: []}
        for batch in batches:
            to = batch.column(0)[0].as_py() if batch.num_rows else to
            for every, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                parts[every].append(pa.ipc.open_stream(data.as_buffer()).read_all())
                del data
            del batch
        if to is None:
            return
        (g, b), own, all_ = tasks[to], pa.concat_tables(parts.pop(False)), pa.concat_tables(parts.pop(True))
        # Negatives are numbered in the order of their keys.
        by_key = pa.compute.sort_indices(own.select(["k"]), sort_keys=[("k", "ascending")], null_placement="at_start")
        k, by_key, own = own.column("k").take(by_key), by_key.to_numpy(), own.drop_columns(["k"])
        pos, neg, every = own.column("pos").to_numpy()[by_key], own.column("neg").to_numpy()[by_key], all_.column("pos").to_numpy()
        for j, score in enumerate(scores):
            values, tops = own.column(f"s{j}").to_numpy()[by_key], all_.column(f"s{j}").to_numpy()
            order = np.argsort(tops)
            tops, of = tops[order], every[order]
            del order
            for i in at:
                chosen, others = np.flatnonzero(pos >> i & 1), np.flatnonzero(neg >> i & 1)
                if not len(chosen) or not len(others):
                    continue
                top, v = tops[of >> i & 1 == 1], values[others]
                order = np.argsort(v)
                v, share_of = v[order], np.empty(len(v))
                share_of[order] = (len(top) - (np.searchsorted(top, v) + np.searchsorted(top, v, "right")) / 2) / len(top)
                prefix, s, suffix_of = "|".join([str(seed), *group_names[g], score, names[i], str(b)]), np.zeros(replicates), k.take(pa.array(chosen))
                for a in range(0, len(chosen), 1 << 16):
                    suffixes = [b"" if x is None else b"|" + x.encode() for x in suffix_of.slice(a, 1 << 16).to_pylist()]
                    for rep in range(replicates):
                        p = f"{prefix}|{rep + 1}".encode()
                        h = np.frombuffer(b"".join([sha256(p + x).digest()[:4] for x in suffixes]), ">u4").astype(np.int64)
                        s[rep] += share_of[h % len(share_of)].sum()
                yield pa.RecordBatch.from_arrays([pa.array([x] * replicates, t) for x, t in ((g, pa.int32()), (score, pa.string()), (i, pa.int32()))] + [pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(s), pa.array([len(chosen)] * replicates, pa.int64())], names=["_g", "score", "cell", "replicate", "s", "c"])

    types = "_g int, score string, cell int, replicate int, s double, c long"
    if not tasks:
        sums = spark.createDataFrame([], types)
    else:
        sent = d.join(F.broadcast(groups), by).drop(*by).mapInArrow(send, "to int, every boolean, data binary")
        sums = sent.repartitionById(len(tasks), "to").mapInArrow(draws, types)
    each = sums.groupBy("_g", "score", "cell", "replicate").agg((F.sum("s") / F.sum("c")).alias("auroc"))
    return each.join(F.broadcast(groups), "_g").select(*by, "score", "cell", "replicate", "auroc")


def multiplicities(clusters: DataFrame, cluster: str, by: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """(by, replicate, cluster, m): how often each cluster is drawn when as many are drawn as there are. One row per
    draw is made on the map side and summed; data rows are never repeated."""
    c = clusters.select(*by, cluster).distinct().withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(cluster)).cast("long"))
    n = c.groupBy(*by).agg(F.max("_i").alias("_n"))
    drawn = c.join(n, by).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_j", draw(F.concat_ws("|", F.lit(seed), *by, F.col("replicate"), F.col("_i")), F.col("_n")))
    counts = drawn.groupBy(*by, "replicate", "_j").agg(F.count(F.lit(1)).alias("m"))
    return counts.join(c.withColumnRenamed("_i", "_j"), [*by, "_j"]).select(*by, "replicate", cluster, "m")


def bootstrap_ratio(sums: DataFrame, multiple: DataFrame, cluster: str, by: list[str], num: str, den: str) -> DataFrame:
    """Replicates of sum(num) / sum(den), from sums per cluster and multiplicities."""
    return sums.join(multiple, [*by, cluster]).groupBy(*by, "replicate").agg((F.sum(F.col("m") * F.col(num)) / F.nullif(F.sum(F.col("m") * F.col(den)), F.lit(0))).alias("ratio"))
