"""Best-fit decreasing packing of documents into sequences.

Documents become token ids followed by an end id; longer ones than a sequence are cut so that all pieces but the first are
full. Full pieces are sequences by themselves. The others go to shards by a hash, and each shard packs from the longest
down: a segment tree over remaining capacities finds the tightest open sequence in logarithmic time per document. Only
piece lengths are shuffled, never tokens. A shard holds `shard_rows` pieces or so, which leaves at most a few sequences per shard partly filled.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; very long texts are encoded in
one piece of work and cut; columns of other names are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of, tidy
from .token_counts import load


def alike(name: str) -> bool:
    """Whether a tokenizer's file has byte-level BPE with the usual pattern and nothing else, and its merges stand in the
    order of their ids: then tiktoken gives the same ids. Read on the driver."""
    file = json.loads(load(name).to_str())
    model, first = file["model"], file["pre_tokenizer"] or {}
    plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if file["normalizer"] or model["type"] != "BPE" or not plain or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
        return False
    ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in ids and ids == sorted(ids)


class PieceIds:
    """Text -> its ids as little-endian bytes. tiktoken encodes whole texts from the same vocabulary and merge order, many times
    faster than the library, if alike() says that both do the same; the first `verify` texts of each worker are compared with
    the library. Where either fails, the library encodes, as it does texts that may hold added tokens or stop tiktoken's
    pattern (runs of white space by the million)."""

    def __init__(self, name: str, verify: int, same: bool):
        self.verify, self.tokenizer = verify, load(name)
        self.fast = self._fast() if same else None

    def _fast(self):
        import tiktoken

        # Byte-level BPE writes the bytes that are no visible characters as code points from 256 on (a fixed rule of the format).
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or "<|" in text:
            return self.whole(text)
        try:
            ids = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # tiktoken's, and no subclass of Exception
                raise
            return self.whole(text)
        if self.verify:
            self.verify -= 1
            if ids != (known := self.whole(text)):  # the encoders differ
                self.fast = None
                return known
        return ids


@functools.lru_cache(1)
def encoder(name: str, verify: int, same: bool) -> PieceIds:
    """One for all tasks of a worker."""
    return PieceIds(name, verify, same)


class Capacities:
    """Segment tree over remaining capacities 0..capacity: each leaf has the open sequences with that much room left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.bins[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room that is at least `least`; the sequence leaves the tree."""
        tree, i = self.open, least + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up until a right neighbour has an open sequence
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not tree[2 * i])
        room = i - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) for each length, placed from the longest down; ties in the order given."""
    tree, out, used = Capacities(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        room, sequence = tree.take(n) or (capacity, used)
        used += sequence == used
        out[k] = (sequence, capacity - room)
        if room > n:
            tree.put(room - n, sequence)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", verify: int = 200) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    same = alike(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "text"):
            encode = encoder(tokenizer, verify, same).encode
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                ids = encode(raw.decode()) + end if raw else end
                total = len(ids) // 4
                first = total - (total - 1) // capacity * capacity
                for i, (a, z) in enumerate(zip([0, *range(first, total, capacity)], range(first, total + 1, capacity))):
                    for column, value in zip(rows, (doc, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    return d.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, shard_rows: int = 250_000, **names: str) -> DataFrame:
    """The pieces of docs with sequence_id and offset: offsets are gapless from 0 in each sequence."""
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, **names), "pieces")
    full = cut.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        placed = best_fit(t.column("length").to_pylist(), capacity)
        shard = TaskContext.get().partitionId() << 34
        t = t.append_column("sequence_id", pa.array([(shard + s) * 2 + 1 for s, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from t.to_batches()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # The row's place among the written pieces parts repeated rows, which would all go to one shard.
    dealt = rest.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())).repartition(shards, "_h").sortWithinPartitions("length", "_h").drop("_h")
    return full.unionByName(dealt.mapInArrow(tidy(place), schema))
