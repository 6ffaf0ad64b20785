"""SimHash near-duplicates: fingerprints, links within a few bits, connected components.

Every fingerprint is embedded as the set-bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings
is never over the Hamming distance of the fingerprints. The range join runs on a grid: the 32 coordinates are cut into
`radius + keep` blocks, and fingerprints within the radius have equal coordinates in at least `keep` of them, so each
choice of `keep` blocks names the cell a fingerprint falls in. In a cell, embeddings are compared by Manhattan distance
and the survivors by exact Hamming distance; a cell gives the edges of a spanning forest of its links, not all pairs,
which has the same components. Copies of a fingerprint go through the join once.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated rows link to each other;
rows with null doc_id are never a component's id unless all are null; very long texts are one row's work; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parted, slices, texts_of, tidy
from .graph import components

LOW = np.uint64(0x5555555555555555)


def fingerprint(raw: bytes, size: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(text, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = len(words) - size + 1
    ends = starts[size - 1 :] + lengths[size - 1 :]
    h = np.fromiter(map(xxh64_intdigest, map(text.__getitem__, map(slice, starts[:n].tolist(), ends.tolist())), repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(x, size, seed) for x in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(tidy(run), "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """Counts 0, 1, 2 of two-bit segments as 00, 01, 11: the Manhattan distance is the popcount of the difference."""
    both = fp & (fp >> np.uint64(1)) & LOW
    return ((fp | fp >> np.uint64(1)) & LOW) | both << np.uint64(1)


def forest(fp: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) with the components of all links within radius among distinct fingerprints. Memory is bounded
    by block * len(fp)."""
    n, u = len(fp), unary(fp)
    label = np.arange(n)
    pairs = []
    for a in range(0, n, block):
        i, j = np.nonzero(np.bitwise_count(u[a : a + block, None] ^ u[None, a:]) <= radius)
        i, j = i + a, j + a
        true = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        i, j = i[true], j[true]
        if len(i):
            # A star of each row block keeps its links' components and no more than n edges.
            while True:
                old = label.copy()
                np.minimum.at(label, j, label[i])
                np.minimum.at(label, i, label[j])
                label = np.minimum(label, label[label])
                if (old == label).all():
                    break
            pairs.append((i, j))
    while True:  # later blocks may have joined what earlier ones saw apart
        old = label.copy()
        for i, j in pairs:
            np.minimum.at(label, j, label[i])
            np.minimum.at(label, i, label[j])
        label = label[label]
        if (old == label).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return fp[member], fp[label[member]]


def links(distinct: DataFrame, radius: int = 4, keep: int = 3) -> DataFrame:
    """distinct (fp) -> edges (a, b) of spanning forests of the links within radius."""
    blocks = np.array_split(np.arange(32), radius + keep)
    masks = [sum(3 << 2 * int(c) for k in chosen for c in blocks[k]) for chosen in combinations(range(radius + keep), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp, low = F.col("fp"), F.lit(int(LOW))
    up = F.shiftrightunsigned(fp, 1)
    ones = fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))  # as unary(): counts 0, 1, 2 as 00, 01, 11
    cells = distinct.select("fp", ones.alias("_ones")).select("fp", "_ones", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("choice", "_mask")).select("fp", "choice", F.col("_ones").bitwiseAND(F.col("_mask")).alias("cell"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(fp, choice, cell) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = ends - starts
            two = starts[size == 2]  # most cells with company
            if len(two):
                x, y = fp[two], fp[two + 1]
                near = np.flatnonzero(np.bitwise_count(unary(x) ^ unary(y)) <= radius)
                near = near[np.bitwise_count(x[near] ^ y[near]) <= radius]
                found.append((x[near], y[near]))
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                found.append(forest(fp[s:e], radius))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                if len(a):
                    a, b = np.unique(np.stack([a, b]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        def joined():
            return [np.concatenate(x) for x in zip(*held)]

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()))
            fp, choice, cell = joined()
            # All but the last cell are complete.
            last = np.flatnonzero((choice != choice[-1]) | (cell != cell[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from done(fp[:cut], choice[:cut], cell[:cut])
            held = [(fp[cut:], choice[cut:], cell[cut:])]
        if held:
            yield from done(*joined())

    return cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell").mapInArrow(tidy(link), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    prints = materialize(fingerprints(docs, size, seed, doc_id, text), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct.select("fp"), radius))
    joined = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = joined.join(ids, "label").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: int) -> DataFrame:
    """The rows of docs, one of each component: that with its id; of rows that repeat this id, one. Where a component has
    no id at all, its rows stay, one of each text. Only rows whose id may go or is not alone are shuffled with their text."""
    none = F.lit(-(2**63)).cast("long")
    own = F.coalesce(F.col(doc_id).cast("long"), none).alias("_first")
    ids = near_duplicates(docs, doc_id=doc_id, text=text, **more).select(F.coalesce("doc_id", none).alias("_first"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("own"))
    ids = materialize(ids.groupBy("_first").agg(F.count(F.lit(1)).alias("n"), F.bool_or("own").alias("own")), "ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own, F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).alias("_t"))
    maybe, rest = parted(rows, ("_first",), ids.where("n > 1 or not own").select("_first"))
    some = maybe.join(ids.where("own").select("_first"), "_first", "left_semi").dropDuplicates(["_first", "_t"])
    return rest.unionByName(some.select(rest.columns)).select("_row.*")
