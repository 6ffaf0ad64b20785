"""Matched controls. Candidates never cross strata, so strata are exact parallel units."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from ..functions.hashing import stable_u32
from ..storage import materialize


class Queues:
    """Controls in lists, each in hash order; the first free one of some lists is found by their heads."""

    def __init__(self, of: np.ndarray, n: int) -> None:
        self.order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=n))
        self.first, self.end = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
        self.at, self.none = self.first.copy(), len(of)
        self.head = np.append(self.order, self.none)[np.where(self.first < self.end, self.first, len(of))]

    def take(self, lists: np.ndarray, k: int, used: np.ndarray, chosen: list[int]) -> None:
        """Append the first free controls of the lists in hash order, until k are chosen; they are used from then on."""
        heads = self.head[lists]
        while len(chosen) < k and len(heads):
            j = int(heads.argmin())
            c = int(heads[j])
            if c == self.none:
                break
            if not used[c]:
                used[c] = True
                chosen.append(c)
            i = lists[j]
            at, end = int(self.at[i]) + 1, int(self.end[i])
            while at < end and used[self.order[at]]:
                at += 1
            self.at[i] = at
            heads[j] = self.head[i] = self.order[at] if at < end else self.none

    def take_any(self, lists: np.ndarray, k: int, chosen: list[int]) -> None:
        """The same with used controls, of which those already chosen are passed over."""
        at = self.first[lists].copy()
        heads = np.append(self.order, self.none)[np.where(at < self.end[lists], at, self.none)]
        while len(chosen) < k and len(heads):
            j = int(heads.argmin())
            c = int(heads[j])
            if c == self.none:
                break
            if c not in chosen:
                chosen.append(c)
            at[j] += 1
            heads[j] = self.order[at[j]] if at[j] < self.end[lists[j]] else self.none


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sorted; the place of each row's)"""
    code = np.zeros(len(values), np.int64)
    for x in values.T:
        u, at = np.unique(x, return_inverse=True)
        code = np.unique(code * len(u) + at, return_inverse=True)[1]
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    return values[first], of


def match_stratum(pos: np.ndarray, con: np.ndarray, pos_gene: np.ndarray, con_gene: np.ndarray, calipers: np.ndarray, k: int, cache: int = 1 << 26) -> Iterator[tuple]:
    """(positive, controls, own gene, reused) of one stratum, by number; rows are in hash order, genes numbers, -1 unknown.
    Controls are held in lists by distinct covariates (cells), alone and within a gene, so no positive's candidates are listed."""
    whole = ~np.isnan(con).any(1)
    number = np.flatnonzero(whole)
    con, con_gene = con[whole], con_gene[whole]
    cells, cell = _cells(con) if len(con) else (con, np.zeros(0, np.int64))
    size = np.bincount(cell, minlength=len(cells))
    all_ = Queues(cell, len(cells))
    mixed, of = np.unique(con_gene * max(len(cells), 1) + cell, return_inverse=True)
    own, own_cell = Queues(of, len(mixed)), mixed % max(len(cells), 1)
    genes = mixed // max(len(cells), 1)
    spots, spot = _cells(pos)

    def near(i: int) -> np.ndarray:
        v = spots[i]
        if not len(cells) or np.isnan(v).any():
            return np.zeros(len(cells), bool)
        out, slack = np.zeros(len(cells), bool), calipers[0] * 1e-6 + abs(v[0]) * 1e-6
        a, z = np.searchsorted(cells[:, 0], [v[0] - calipers[0] - slack, v[0] + calipers[0] + slack])
        out[a:z] = (np.abs(cells[a:z] - v) <= calipers).all(1)
        return out

    candidates = np.array([size[near(i)].sum() for i in range(len(spots))], np.int64)
    used, known, held = np.zeros(len(con), bool), {}, 0
    for at in np.lexsort([np.arange(len(pos)), candidates[spot]]):
        i = int(spot[at])
        if i not in known:
            if held > cache:
                known, held = {}, 0
            mask = near(i)
            known[i] = mask, np.flatnonzero(mask)
            held += 9 * len(cells)
        mask, lists = known[i]
        if not len(lists):
            continue
        a, z = np.searchsorted(genes, [pos_gene[at], pos_gene[at] + 1]) if pos_gene[at] >= 0 else (0, 0)
        mine = a + np.flatnonzero(mask[own_cell[a:z]])
        chosen: list[int] = []
        own.take(mine, k, used, chosen)
        all_.take(lists, k, used, chosen)
        fresh = len(chosen)
        if fresh < k:
            own.take_any(mine, k, chosen)
            all_.take_any(lists, k, chosen)
        yield int(at), [int(number[c]) for c in chosen], [bool(pos_gene[at] >= 0 and con_gene[c] == pos_gene[at]) for c in chosen], [n >= fresh for n in range(len(chosen))]


def matched_controls(df: DataFrame, strata: list[str], key: str, gene: str, positive: str, covariates: dict[str, float], k: int = 10, seed: int = 42) -> DataFrame:
    """Up to k controls per positive within calipers, in four passes: unused of the same gene, unused, reused of the same
    gene, reused. Positives with fewest candidates go first; order within a pass is a hash. (strata, positive, control, rank, same_gene, reused)

    A stratum is matched in sequence by one task, which holds numbers only: rows are numbered in hash order beforehand, and
    the matches are joined with the keys."""
    names = list(covariates)
    d = df.select(*strata, F.col(key).alias("_k"), F.col(gene).alias("_g"), F.col(positive).alias("_p"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)], stable_u32(F.concat_ws("|", F.lit(seed), F.col(key))).alias("_h"))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy(*strata, "_p").orderBy("_h", "_k")) - 1).drop("_h")
    d = materialize(d, "candidates")
    calipers = np.array([covariates[c] for c in names], float)

    def match(t: pa.Table) -> pa.Table:
        t = t.select(["_p", "_n", "_g", *[f"_c{i}" for i in range(len(names))], *strata])
        stratum = [t.column(s)[:1].to_pylist()[0] for s in strata]
        p, n = t.column("_p").to_numpy(), t.column("_n").to_numpy()
        gene_of = pa.compute.fill_null(t.column("_g").combine_chunks().dictionary_encode().indices, -1).to_numpy()
        x = np.stack([t.column(f"_c{i}").to_numpy() for i in range(len(names))], 1)
        del t
        sides = []
        for side in (np.flatnonzero(p), np.flatnonzero(~p)):
            side = side[np.argsort(n[side])]
            sides.append((x[side], gene_of[side].astype(np.int64)))
        (pos, pos_gene), (con, con_gene) = sides
        del x, p, n, gene_of
        most = len(pos) * k
        at, to, rank, same, again, m = np.zeros(most, np.int32), np.zeros(most, np.int32), np.zeros(most, np.int32), np.zeros(most, bool), np.zeros(most, bool), 0
        for a, controls, own, reused in match_stratum(pos, con, pos_gene, con_gene, calipers, k):
            s = slice(m, m + len(controls))
            at[s], to[s], rank[s], same[s], again[s] = a, controls, np.arange(1, len(controls) + 1), own, reused
            m = s.stop
        columns = [pa.array([v] * m, f.type) for v, f in zip(stratum, out)]
        return pa.table([*columns, *[pa.array(v[:m]) for v in (at, to, rank, same, again)]], schema=out)

    kinds = [(s, df.schema[s].dataType) for s in strata]
    out = pa.schema([*[(s, to_arrow_type(v)) for s, v in kinds], ("_at", pa.int32()), ("_to", pa.int32()), ("rank", pa.int32()), ("same_gene", pa.bool_()), ("reused", pa.bool_())])
    types = ", ".join(f"`{s}` {v.simpleString()}" for s, v in kinds)
    m = d.drop("_k").groupBy(*strata).applyInArrow(match, f"{types}, _at int, _to int, rank int, same_gene boolean, reused boolean")
    for on, name, side in (("_at", "positive", F.col("_p")), ("_to", "control", ~F.col("_p"))):
        keys = d.where(side).select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_n").alias(f"_n{on}"), F.col("_k").alias(name))
        same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
        m = m.join(keys, [F.col(on) == F.col(f"_n{on}"), *same]).drop(f"_n{on}", *[f"_s{i}" for i in range(len(strata))])
    return m.select(*strata, "positive", "control", "rank", "same_gene", "reused")


def _ints(x: np.ndarray) -> array:
    """As numbers of four bytes that Python reads one at a time."""
    return array("i", x.astype(np.int32).tobytes())


class Free:
    """Controls in lists, each in order of their numbers, with what is left of them while they are used up."""

    def __init__(self, of: np.ndarray, n: int) -> None:
        self.of, self.order = _ints(of), _ints(np.argsort(of, kind="stable"))
        self.size = np.bincount(of, minlength=n)
        self.end, self.first = _ints(np.cumsum(self.size)), _ints(np.cumsum(self.size) - self.size)
        self.reset()

    def reset(self) -> None:
        self.at, self.left = self.first[:], self.size.copy()

    def nearest(self, lists: np.ndarray, scores: np.ndarray, need: int, used: bytearray | None, but: list[int]) -> list[int]:
        """The first controls by score, then number, that are not used and not in `but`; lists have something left, in order of their scores.
        Used controls count too if no flags are given."""
        most = need + len(but)
        if len(lists) > most:
            most = int(np.searchsorted(scores, scores[most - 1], "right"))
        out, order, end, last = [], self.order, self.end, None
        for i, s in zip(lists[:most].tolist(), scores[:most].tolist()):
            if len(out) >= need and s > last:
                break
            at, z, m, last = self.at[i] if used else self.first[i], end[i], 0, s
            if used:
                while at < z and used[order[at]]:
                    at += 1
                self.at[i] = at
            while at < z and m < need:
                c = order[at]
                if not (used and used[c]) and c not in but:
                    out.append((s, c))
                    m += 1
                at += 1
        out.sort()
        return [c for _, c in out[:need]]


class NearestPool:
    """Controls of one stratum's positives, in repeated draws. Candidates within the calipers are ordered by the sum of their distances, each by
    its scale, then by number. Of the first `pool` of what a pass may take, controls are drawn without replacement with the
    squares of their places as inverse weights. Rows are in order of their keys; genes are numbers, -1 unknown. Controls with equal covariates
    share a list, so of a positive's candidates only the lists are held, up to `cache` bytes of them."""

    def __init__(self, pos: np.ndarray, con: np.ndarray, pos_gene: np.ndarray, con_gene: np.ndarray, calipers: np.ndarray, scales: np.ndarray, k: int, pool: int, cache: int = 1 << 27) -> None:
        self.number = np.flatnonzero(~np.isnan(con).any(1))
        con, con_gene = con[self.number], con_gene[self.number]
        self.cells, cell = _cells(con) if len(con) else (con, np.zeros(0, np.int64))
        n = max(len(self.cells), 1)
        mixed, of = np.unique(con_gene * n + cell, return_inverse=True)
        self.all, self.own, self.own_cell = Free(cell, len(self.cells)), Free(of, len(mixed)), mixed % n
        self.spots, self.spot = _cells(pos)
        self.gene, self.con_gene = _ints(pos_gene), _ints(con_gene)
        self.ends = np.searchsorted(mixed // n, [pos_gene, pos_gene + 1]).T.tolist()
        self.calipers, self.scales, self.k, self.pool, self.cache = calipers, scales, k, pool, cache
        self.known, self.held, self.tops, self.own_tops = {}, 0, {}, {}
        self.candidates = np.array([self.all.size[self.near(i)[1]].sum() for i in range(len(self.spots))], np.int64)[self.spot]

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of every list, infinite beyond the calipers; lists within them by score; their scores) at a spot."""
        if i not in self.known:
            if self.held > self.cache:
                self.known, self.held = {}, 0
            gap = np.abs(self.cells - self.spots[i])
            score = np.where((gap <= self.calipers).all(1), sum(g / s for g, s in zip(gap.T, self.scales)) if len(gap) else 0.0, np.inf)
            lists = np.flatnonzero(score < np.inf)
            lists = lists[np.argsort(score[lists], kind="stable")].astype(np.int32)
            self.known[i] = score, lists, score[lists]
            self.held += 8 * len(score) + 12 * len(lists)
        return self.known[i]

    def mine(self, at: int, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Lists of the positive's gene within the calipers and their scores; only those with something left, if so."""
        if self.gene[at] < 0:
            return np.zeros(0, np.int64), np.zeros(0)
        a, z = self.ends[at]
        score = self.near(int(self.spot[at]))[0][self.own_cell[a:z]]
        some = np.flatnonzero((score < np.inf) & (self.own.left[a:z] > 0) if left else score < np.inf)
        score = score[some]
        order = np.argsort(score, kind="stable")
        return a + some[order], score[order]

    def iteration(self, key: str) -> Iterator[tuple[int, list[int], list[bool], list[bool]]]:
        """(positive, controls as drawn, own gene, reused) with draws keyed by a text."""
        rng = np.random.RandomState(np.frombuffer(sha256(key.encode()).digest(), ">u4").astype(np.uint32))
        k, pool, free, own = self.k, self.pool, self.all, self.own
        free.reset()
        own.reset()
        used, alive, size, races, weight = bytearray(len(free.of)), {}, 0, [], [(n + 1.0) ** 2 for n in range(max(pool, k))]

        def pick(found: list[int], n: int) -> list[int]:
            nonlocal races
            if len(found) <= n:
                return found
            if len(races) < len(found):
                races = (-np.log1p(-rng.random_sample(1 << 14 if len(found) <= 1 << 14 else len(found)))).tolist()
            drawn = sorted((races.pop() * w, c) for w, c in zip(weight, found))
            return [c for _, c in drawn[:n]]

        uniform = rng.random_sample(len(self.spot))
        for at in np.lexsort([uniform, self.candidates]).tolist():
            if not self.candidates[at]:
                continue
            i, chosen = int(self.spot[at]), []
            lists, scores = self.mine(at, True)
            if len(lists):
                chosen = pick(own.nearest(lists, scores, max(pool, k), used, chosen), k)
            if len(chosen) < k:
                lists, scores = alive[i] if i in alive else self.near(i)[1:]
                some = free.left[lists] > 0
                if not some.all():
                    lists, scores = lists[some], scores[some]
                    if size > self.cache:
                        alive, size = {}, 0
                    alive[i] = lists, scores
                    size += 12 * len(lists)
                if len(lists):
                    n = k - len(chosen)
                    chosen = chosen + pick(free.nearest(lists, scores, max(pool, n), used, chosen), n)
            if len(chosen) < k:
                # What may be reused does not change: the first of pool and those already chosen are enough.
                top = (i, self.gene[at])
                if top not in self.own_tops:
                    if len(self.own_tops) >= 1 << 17:
                        self.own_tops.clear()
                    self.own_tops[top] = own.nearest(*self.mine(at, False), max(pool, k) + k, None, [])
                n = k - len(chosen)
                chosen = chosen + pick([c for c in self.own_tops[top] if c not in chosen][: max(pool, n)], n)
            if len(chosen) < k:
                if i not in self.tops:
                    self.tops[i] = free.nearest(*self.near(i)[1:], max(pool, k) + k, None, [])
                n = k - len(chosen)
                chosen = chosen + pick([c for c in self.tops[i] if c not in chosen][: max(pool, n)], n)
            again, gene = [bool(used[c]) for c in chosen], self.gene[at]
            for c, old in zip(chosen, again):
                if not old:
                    used[c] = 1
                    free.left[free.of[c]] -= 1
                    own.left[own.of[c]] -= 1
            yield at, chosen, [gene >= 0 and self.con_gene[c] == gene for c in chosen], again


def nearest_pool_controls(df: DataFrame, strata: list[str], key: str, gene: str, positive: str, covariates: dict[str, tuple[float, float]], k: int = 10, pool: int = 12, iterations: int = 100, seed: int = 42, at_once: int = 25, batch: int = 1 << 17) -> DataFrame:
    """Up to k controls per positive and iteration within calipers, in the four passes of matched_controls, each of which draws from the nearest
    `pool` (NearestPool). Covariates have a caliper and a scale. Positives with fewest candidates go first, equal ones in an order drawn anew in
    every iteration. Draws are keyed by seed, iteration and stratum. (strata, iteration, positive, control, rank, same_gene, reused)

    A task makes `at_once` iterations of one stratum, for each of which its rows are sent, and matches leave it with their keys in batches: none
    are joined. Rows without a stratum are left out."""
    names, blocks = list(covariates), -(-iterations // at_once)
    d = df.dropna(subset=strata).select(*strata, F.col(key).alias("_k"), F.col(gene).alias("_g"), F.col(positive).alias("_p"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)])
    calipers, scales = (np.array([covariates[c][i] for c in names], float) for i in (0, 1))
    kinds = [(s, df.schema[s].dataType) for s in strata]
    ends = [("positive", df.schema[key].dataType), ("control", df.schema[key].dataType)]
    out = pa.schema([*[(s, to_arrow_type(t)) for s, t in kinds], ("iteration", pa.int32()), *[(s, to_arrow_type(t)) for s, t in ends], ("rank", pa.int32()), ("same_gene", pa.bool_()), ("reused", pa.bool_())])
    types = ", ".join([*[f"`{s}` {t.simpleString()}" for s, t in kinds], "iteration int", *[f"{s} {t.simpleString()}" for s, t in ends], "rank int, same_gene boolean, reused boolean"])

    def match(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *stratum, block = [v.as_py() for v in group]
        t = pa.Table.from_batches(list(batches)).select(["_k", "_g", "_p", *[f"_c{i}" for i in range(len(names))]])
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("_k", "ascending")])).combine_chunks()
        gene_of = pa.compute.fill_null(t.column("_g").combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        p, keys = t.column("_p").fill_null(False).to_numpy(), t.column("_k").combine_chunks()
        x = np.stack([t.column(f"_c{i}").to_numpy() for i in range(len(names))], 1)
        del t
        pos, con = np.flatnonzero(p), np.flatnonzero(~p)
        if not len(pos) or not len(con):
            return
        m = NearestPool(x[pos], x[con], gene_of[pos], gene_of[con], calipers, scales, k, pool)
        del x, p, gene_of
        con = con[m.number]

        def rows(iteration: int, held: list[tuple]) -> pa.RecordBatch:
            sizes = [len(h[1]) for h in held]
            to = np.array([c for h in held for c in h[1]], np.int64)
            flags = [pa.array([f for h in held for f in h[i]], pa.bool_()) for i in (2, 3)]
            rank = np.arange(len(to)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            columns = [pa.array([v] * len(to), f.type) for v, f in zip([*stratum, iteration], out)]
            return pa.RecordBatch.from_arrays([*columns, keys.take(pa.array(np.repeat(pos[[h[0] for h in held]], sizes))), keys.take(pa.array(con[to])), pa.array(rank.astype(np.int32)), *flags], schema=out)

        for iteration in range(block * at_once, min((block + 1) * at_once, iterations)):
            held = []
            for h in m.iteration("|".join(map(str, [seed, iteration, *stratum]))):
                held.append(h)
                if len(held) * k >= batch:
                    yield rows(iteration, held)
                    held = []
            if held:
                yield rows(iteration, held)

    # The number of partitions is given, since small ones would be put together: a task's time is not in its rows.
    n = max(200, 4 * df.sparkSession.sparkContext.defaultParallelism)
    d = d.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, *strata, "_block")
    return d.groupBy(*strata, "_block").applyInArrow(match, types)


class Nearest:
    """Greedy nearest matching of one stratum as a stream. Rows come from the largest value down, at equal values side 0 first
    with its largest key, then side 1 by key. What is over a row of side 1 is a stack whose top is nearest, and the first free
    row under it is the next to come; rows out of the caliper's reach are dropped, so only those within it are held."""

    def __init__(self, caliper: float) -> None:
        self.caliper, self.over, self.waiting, self.found = caliper, deque(), deque(), []

    def _settle(self) -> None:
        """The first waiting row takes what is over it, if that is near enough."""
        v, row = self.waiting.popleft()
        if self.over and self.over[-1][0] - v <= self.caliper:
            w, other = self.over.pop()
            self.found.append((row, other, w - v))

    def add(self, value: float, treated: bool, row: tuple) -> None:
        waiting, over, caliper = self.waiting, self.over, self.caliper
        while waiting and waiting[0][0] - value > caliper:
            self._settle()
        while over and over[0][0] - value > caliper:
            # Rows that wait are at or above the value, so they may still be near it.
            if waiting and over[0][0] - waiting[0][0] <= caliper:
                break
            over.popleft()
        if treated:
            waiting.append((value, row))
            return
        while waiting:
            v = waiting[0][0]
            if over and over[-1][0] - v < v - value:
                self._settle()
                continue
            self.found.append((waiting.popleft()[1], row, v - value))
            return
        over.append((value, row))

    def end(self) -> list[tuple]:
        while self.waiting:
            self._settle()
        return self.take()

    def take(self) -> list[tuple]:
        out, self.found = self.found, []
        return out


def nearest_pairs(df: DataFrame, strata: list[str], key: str, side: str, value: str, caliper: float, keep: list[str] | None = None) -> DataFrame:
    """1:1 greedy nearest matching without replacement within strata: from the largest value down, each row of side 1
    takes the free row of side 0 that is nearest, ties by key. A stratum is one task's stream, sorted by Spark; rows without a
    value match none. Columns to keep follow as <column>_treated and <column>_control."""
    keep = keep or []
    row = [key, *keep]
    d = df.where(F.col(side).isin(0, 1) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    d = d.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col(value).cast("double").alias("_v"), (F.col(side) == 1).alias("_t"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(row)])
    own = [f"_s{i}" for i in range(len(strata))]
    d = (d.repartition(*own) if own else d.repartition(1)).sortWithinPartitions(*own, F.col("_v").desc(), "_t", F.when(~F.col("_t"), F.col("_r0")).desc(), "_r0")
    kinds = [(s, df.schema[s].dataType) for s in strata] + [(n, df.schema[key].dataType) for n in ("treated", "control")] + [("gap", DoubleType())]
    kinds += [(f"{c}_{n}", df.schema[c].dataType) for c in keep for n in ("treated", "control")]
    out = pa.schema([(n, to_arrow_type(t)) for n, t in kinds])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Nearest(caliper)

        def batch(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                t, c, gap = zip(*found)
                t, c = list(zip(*t)), list(zip(*c))
                columns = [[v] * len(gap) for v in now or ()] + [t[0], c[0], gap] + [x for pair in zip(t[1:], c[1:]) for x in pair]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)

        for b in batches:
            of = list(zip(*[c.to_pylist() for c in b.columns[: len(own)]])) if own else [()] * b.num_rows
            v, t, *r = [c.to_pylist() for c in b.columns[len(own) :]]
            # Few different values are held once.
            r[1:] = [[one.setdefault(x, x) for x in c] for c, one in zip(r[1:], ({} for _ in keep))]
            for s, x, side1, held in zip(of, v, t, zip(*r)):
                if s != now:
                    yield from batch(state.end())
                    now, state = s, Nearest(caliper)
                state.add(x, side1, held)
            yield from batch(state.take())
        yield from batch(state.end())

    return d.mapInArrow(match, ", ".join(f"`{n}` {t.simpleString()}" for n, t in kinds))


def hash_pairs(df: DataFrame, strata: list[str], key: str, side: str, seed: int = 3, keep: list[str] | None = None) -> DataFrame:
    """1:1 matching at random without replacement: both sides are numbered by a hash within the stratum, equal numbers meet.
    Rows move once, to the stratum's task; columns to keep follow as <column>_treated and <column>_control."""
    keep = [c for c in keep or [] if c not in strata]
    d = df.where(F.col(side).isin(0, 1)).select(*strata, key, side, *keep)
    for s in strata:
        d = d.where(F.col(s).isNotNull())
    d = d.repartition(*strata) if strata else d.repartition(1)
    order = W.partitionBy(*strata, side).orderBy(stable_u32(F.concat_ws("|", F.lit(seed), F.col(key))), key)
    d = d.withColumn("_i", F.row_number().over(order))
    # Of a pair, side 1 follows side 0.
    before = W.partitionBy(*strata, "_i").orderBy(side)
    d = d.withColumns({f"_c{n}": F.lag(c).over(before) for n, c in enumerate([key, *keep])}).withColumn("_both", F.count(F.lit(1)).over(before) == 2)
    more = [x for n, c in enumerate(keep, 1) for x in (F.col(c).alias(f"{c}_treated"), F.col(f"_c{n}").alias(f"{c}_control"))]
    return d.where(F.col("_both") & (F.col(side) == 1)).select(*strata, "_i", F.col(key).alias("treated"), F.col("_c0").alias("control"), *more).drop("_i")


def ablation(df: DataFrame, sets: dict[str, tuple[list[str], bool]], key: str, side: str, value: str, caliper: float, keep: list[str] | None = None) -> DataFrame:
    """covariates, treated, control, gap: the same rows matched under each set of (exact strata, whether value must be near).
    With value the nearest free row within the caliper is taken, else a random one of the stratum. Rows are stored once for
    all sets; columns to keep come along as <column>_treated and <column>_control, so that no pair has to be joined with them."""
    keep, columns = keep or [], []
    for c in [key, side, value, *(keep or []), *[s for strata, _ in sets.values() for s in strata]]:
        columns += [c] if c not in columns else []
    df = materialize(df.select(*columns), "ablation")
    ends = [f"{c}_{n}" for c in keep for n in ("treated", "control")]
    parts = []
    for name, (strata, near) in sets.items():
        if near:
            m = nearest_pairs(df, strata, key, side, value, caliper, keep).select("treated", "control", "gap", *ends)
        else:
            m = hash_pairs(df, strata, key, side, keep=list(dict.fromkeys([value, *keep])))
            both = lambda c: [F.col(c if c in strata else f"{c}_{n}").alias(f"{c}_{n}") for n in ("treated", "control")]  # noqa: E731, B023
            gap = F.abs(F.col(f"{value}_treated") - F.col(f"{value}_control")) if value not in strata else F.lit(0.0)
            m = m.select("treated", "control", gap.alias("gap"), *[x for c in keep for x in both(c)])
        parts.append(m.select(F.lit(name).alias("covariates"), "*"))
    out = parts[0]
    for m in parts[1:]:
        out = out.unionByName(m)
    return out


def balance(df: DataFrame, by: list[str], treated: str, x: str) -> DataFrame:
    """Standardised mean difference per group."""
    t, c = F.when(F.col(treated), F.col(x)), F.when(~F.col(treated), F.col(x))
    d = df.groupBy(*by).agg(F.avg(t).alias("mean_1"), F.avg(c).alias("mean_0"), F.var_samp(t).alias("_v1"), F.var_samp(c).alias("_v0"))
    pooled = F.sqrt((F.col("_v1") + F.col("_v0")) / 2)
    return d.select(*by, "mean_1", "mean_0", F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / pooled).alias("smd"))


def mantel_haenszel(df: DataFrame, by: list[str], stratum: list[str], exposed: str, case: str) -> DataFrame:
    """Log odds ratio over strata and the chi-square without correction; +-inf where one side is empty."""
    one = lambda e, c: F.count_if((F.col(exposed) == e) & (F.col(case) == c)).cast("double")
    t = df.groupBy(*by, *stratum).agg(one(True, True).alias("a"), one(True, False).alias("b"), one(False, True).alias("c"), one(False, False).alias("d")).withColumn("n", F.expr("a + b + c + d"))
    var = F.when(F.col("n") > 1, F.expr("(a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))"))
    s = t.groupBy(*by).agg(F.sum(F.expr("a * d / n")).alias("num"), F.sum(F.expr("b * c / n")).alias("den"), F.sum(F.expr("a - (a + b) * (a + c) / n")).alias("dev"), F.sum(var).alias("var"), F.count_if((F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)).alias("informative"))
    log_or = F.when((F.col("num") > 0) & (F.col("den") > 0), F.log(F.expr("num / nullif(den, 0)"))).when(F.col("num") > 0, F.lit(float("inf"))).when(F.col("den") > 0, F.lit(float("-inf")))
    return s.select(*by, "informative", log_or.alias("log_or"), F.when(F.col("var") > 0, F.expr("dev * dev / nullif(var, 0)")).alias("chi2"))
