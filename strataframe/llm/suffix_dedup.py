"""Exact removal of long repeated byte strings with a run-length compressed suffix index.

1. Every window of `length` bytes chooses an anchor, the least hash among its grams (a sixth of the window long). Equal
   windows choose equal anchors, so all occurrences of a repeated window meet under one anchor key, and windows whose
   anchor occurs once are unique. Runs of windows under one anchor are segments; equal segments are counted, not repeated.
2. Each shard of anchor groups gets a `RunLengthIndex`: a Burrows-Wheeler transform of its distinct segments, whose copies
   only lengthen its runs, and suffix positions sampled at run ends with the match length across each run border. Matching
   statistics (the longest match of every position with any other position) are streamed from the samples alone, and
   positions with `length` or more are marked.
3. Marks go back to every occurrence of a segment, and spans are merged per document.

An anchor group over `group_bytes` is routed more finely before it is indexed: its windows are cut into blocks by their
place relative to the anchor, which equal windows share, and a block is keyed by the bytes that all its windows share. The
blocks are halved until each group fits. At blocks of one window a group is one string with copies, so this always ends,
whatever passage many documents have in common, and every window is judged by an index.

Segments are told apart by two 64-bit hashes, of the anchor and of the segment; bytes are compared within a group only.

Defined results: null texts are empty and lose nothing; texts under `length` bytes lose nothing; a repeated row is
another occurrence of its text, so both lose every byte; very long texts are cut into pieces that overlap by a window less a byte; columns of other
names pass through where rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import doc_keys, materialize, parted, release, slices, text_buffers, texts_of, tidy

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_size(length: int) -> int:
    """Bytes of an anchor: longer ones are rarely shared by chance, shorter ones make fewer segments."""
    return max(4, length * 4 // 25)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n; n is bounded by PIECE and a window."""
    if base not in _powers or len(_powers[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def prefix_hash(raw: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def gram_hash(prefix: np.ndarray, base: int, start: np.ndarray | slice, size: np.ndarray | int) -> np.ndarray:
    """Hashes of raw[start : start + size]; start may be slice(None) for all starts."""
    n = len(prefix) - 1
    down = powers(base, n + 1)[1]
    if isinstance(start, slice):
        return mixed((prefix[size:] - prefix[: n + 1 - size]) * down[: n + 1 - size])
    return mixed((prefix[start + size] - prefix[start]) * down[start] + np.asarray(size).astype(np.uint64))


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of key[i : i + width] for every i: prefix and suffix minima of blocks."""
    n = len(key)
    blocks = -(-n // width)
    k = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    k[:n] = key
    k = k.reshape(blocks, width)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    behind = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def least_grams(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every gram, place of the least gram of every window); the first of equal ones."""
    gram = gram_size(length)
    grams = gram_hash(prefix_hash(raw, BASES[0]), BASES[0], slice(None), gram)
    at = sliding_least((grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    return grams, (at & np.uint64(0xFFFFFF)).astype(np.int64)


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor key, segment hash) of every run of windows under one anchor. At most 16 MB at once."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    grams, at = least_grams(raw, length)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= offsets[1:][doc]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty, empty, empty, empty, empty
    # A run ends before the next start, or where its document's last window is.
    ends = np.minimum(np.append(starts[1:], n), offsets[1:][doc[starts]] - length + 1)
    windows = ends - starts
    whole = gram_hash(prefix_hash(raw, BASES[1]), BASES[1], starts, windows + length - 1)
    return doc[starts], starts - offsets[doc[starts]], windows, grams[at[starts]].view(np.int64), whole.view(np.int64)


class RunLengthIndex:
    """Run-length compressed transform of byte strings, each with a terminator of its own. A string with copies is sorted
    once: the rows of its copies stand next to each other, so they lengthen runs and match over the whole rest."""

    def __init__(self, texts: list[bytes], copies: list[int] | None = None):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.copies = np.ones(len(texts), np.int64) if copies is None else np.array(copies, np.int64)
        raw = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        self.n = n = len(raw)
        self.ends = np.cumsum(self.sizes + 1) - 1  # of the terminators
        self.begins = self.ends - self.sizes
        s = raw + np.uint8(1)  # UTF-8 has no byte 255
        s[self.ends] = 0
        self.s = s
        self.rest = np.repeat(self.ends, self.sizes + 1) - np.arange(n)  # bytes before the terminator
        self._sort()
        self._sample()

    def _ranked(self, high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, ranks from 1) by high, low, position; low < 2 ** bits."""
        n, b = self.n, max(1, (self.n + 1).bit_length())
        if int(high.max()).bit_length() + bits + b <= 64:
            key = (high.astype(np.uint64) << np.uint64(bits + b)) | (low.astype(np.uint64) << np.uint64(b)) | np.arange(n, dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << b) - 1)).astype(np.int64)
            key >>= np.uint64(b)
        else:
            key = (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank = np.ones(n, np.int32)
        rank[1:] += np.cumsum(key[1:] != key[:-1], dtype=np.int32)
        ranks = np.empty(n, np.int32)
        ranks[order] = rank
        return order, ranks

    def _sort(self) -> None:
        """Suffix order by doubling: ranks by 5, 10, 20, ... bytes, kept for the match lengths."""
        n, h = self.n, 5
        wide = np.concatenate([self.s, np.zeros(h, np.uint8)]).astype(np.uint64)
        key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(h):
            byte = wide[j : n + j] * alive
            key = key << np.uint64(8) | byte
            alive &= byte != 0
        self.order, ranks = self._ranked(key, np.zeros(n, np.uint64), 0)
        self.levels = [(h, ranks)]
        longest = int(self.sizes.max(initial=0)) + 1
        b = max(1, (n + 1).bit_length())
        while h < longest and self.levels[-1][1].max() < n:
            ahead = np.zeros(n, np.int32)
            ahead[: n - h] = ranks[h:]
            ahead[self.rest < h] = 0
            self.order, ranks = self._ranked(ranks, ahead, b)
            h *= 2
            self.levels.append((h, ranks))

    def _matched(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes x and y have in common."""
        most = np.minimum(self.rest[x], self.rest[y])
        out = np.zeros(len(x), np.int64)
        for h, ranks in reversed(self.levels):
            go = out <= most
            a, b = np.where(go, x + out, x), np.where(go, y + out, y)
            out += h * (go & (ranks[a] == ranks[b]))
        for _ in range(self.levels[0][0]):
            go = out < most
            a, b = np.where(go, x + out, x), np.where(go, y + out, y)
            out += go & (self.s[a] == self.s[b])
        return np.minimum(out, most)

    def _sample(self) -> None:
        order, n = self.order, self.n
        before = self.s[order - 1]
        before[order == 0] = 0
        border = np.ones(n + 1, bool)  # between ranks r - 1 and r
        border[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        inner = np.flatnonzero(border[1:-1]) + 1
        match = np.zeros(n + 1, np.int64)
        match[inner] = self._matched(order[inner - 1], order[inner])
        heads, tails = np.flatnonzero(border[:-1]), np.flatnonzero(border[1:])
        self.runs = len(heads)
        rows = np.repeat(self.copies, self.sizes + 1)[order]
        self.run_lengths = np.add.reduceat(rows, heads) if n else rows
        self.heads, self.head_match = order[heads], match[heads]
        self.tails, self.tail_match = order[tails], match[tails + 1]
        del self.levels, self.order

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match with any other position. Within a run the match with the neighbour grows by
        one per step to the left, so the last sample before a position determines it."""
        out = np.zeros(self.n, np.int64)
        for at, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            reach = np.full(self.n, -1, np.int64)
            reach[at] = at + match
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n), out=out)
        return np.where(np.repeat(self.copies > 1, self.sizes + 1), self.rest, out)

    def spans(self, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per segment the (begins, ends) of bytes under windows that occur at another position too."""
        hit = np.zeros(self.n + 1, bool)
        hit[:-1] = self.matching_statistics() >= length
        change = np.flatnonzero(hit[1:] != hit[:-1]) + 1
        if hit[0]:
            change = np.concatenate([[0], change])
        a, z = change[::2], change[1::2]
        owner = np.searchsorted(self.ends, a)
        cuts = np.searchsorted(owner, np.arange(len(self.ends) + 1))
        a, z = a - self.begins[owner], z - self.begins[owner] + length - 1
        return [(a[i:j], z[i:j]) for i, j in zip(cuts, cuts[1:])]


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PIECE):
            raw, offsets = text_buffers(b.column(2))
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            for a in range(0, max(1, len(raw) if b.num_rows == 1 else 1), PIECE):  # a longer text goes in pieces that share length - 1 bytes
                part, at = (raw[a : a + PIECE + length - 1], np.array([0, min(len(raw) - a, PIECE + length - 1)])) if b.num_rows == 1 else (raw, offsets)
                doc, start, windows, anchor, whole = segments(part, at, length)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((k1[doc], k2[doc], start + a, windows, anchor, whole), schema.types)], schema=schema)

    return docs.where(F.octet_length("text") >= length).mapInArrow(tidy(find), "_k1 long, _k2 long, at long, windows int, anchor long, segment long")


BODIES = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()), ("body", pa.binary())])
BODY_ROWS = "anchor long, segment long, copies long, body binary"


def _cut(d: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments from the document that has them first: anchor, segment, copies, body."""
    lists = wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("at", "windows", "anchor", "segment", "copies")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            parts = b.column(1)
            flat, per = parts.flatten(), np.diff(np.asarray(parts.offsets))
            at, windows, anchor, segment, copies = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            texts, owner = texts_of(b.column(0)), np.repeat(np.arange(b.num_rows), per)
            # Repeated rows ask for the same segments.
            some = np.sort(np.unique(np.stack([anchor, segment]), axis=1, return_index=True)[1])
            at, windows, owner = at[some], windows[some], owner[some]
            body = [texts[o][a:z] for o, a, z in zip(owner.tolist(), at.tolist(), (at + windows + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(segment[some]), pa.array(copies[some]), pa.array(body, pa.binary())], schema=BODIES)

    maybe, _ = parted(d, ("_k1", "_k2"), wanted.select("_k1", "_k2"))
    return maybe.join(lists, ["_k1", "_k2"]).select("text", "parts").mapInArrow(tidy(cut), BODY_ROWS)


def _mark(bodies: DataFrame, length: int, shard: int) -> DataFrame:
    """anchor, segment, begins, ends: the spans found by the index of each shard of whole anchor groups."""
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def index(keys: list[tuple[int, int]], copies: list[int], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [(*key, a, z) for key, (a, z) in zip(keys, RunLengthIndex(bodies, copies).spans(length)) if len(a)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, copies, bodies, size = [], [], [], 0
        for b in batches:
            for anchor, segment, n, body in zip(*(c.to_pylist() for c in b.columns)):
                if keys and (anchor, segment) == keys[-1]:
                    continue  # cut from another of its repeated rows
                if keys and anchor != keys[-1][0] and size >= shard:
                    yield from index(keys, copies, bodies)
                    keys, copies, bodies, size = [], [], [], 0
                keys.append((anchor, segment))
                copies.append(n)
                bodies.append(body)
                size += len(body) + 1
        if keys:
            yield from index(keys, copies, bodies)

    dealt = bodies.repartition("anchor").sortWithinPartitions("anchor", "segment")
    return dealt.mapInArrow(tidy(mark), "anchor long, segment long, begins array<int>, ends array<int>")


BLOCKS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("off", pa.int32()), ("group", pa.int64()), ("block", pa.int64()), ("copies", pa.int64()), ("place", pa.int32()), ("body", pa.binary())])
BLOCK_ROWS = "anchor long, segment long, off int, group long, block long, copies long, place int, body binary"


def _halved(rows: DataFrame, length: int, size: int) -> DataFrame:
    """Blocks of `size` places of segments or of larger blocks: off is the block's place in its segment, place that of its
    first window (0 if the anchor ends it). A group shares the bytes that all windows of its block have."""
    width = length - gram_size(length) + 1
    whole = "place" not in rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", PIECE):
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
            if whole:
                raw, offsets = text_buffers(b.column(b.schema.get_field_index("body")))
                first = least_grams(raw, length)[1][offsets[:-1]] - offsets[:-1]
                cols |= {"off": [0] * b.num_rows, "place": (width - 1 - first).tolist()}
            out: list[tuple] = []
            for anchor, segment, off, copies, place, body in zip(*(cols[c] for c in ("anchor", "segment", "off", "copies", "place", "body"))):
                last = place + len(body) - length  # place of the last window
                for j in range(place // size, last // size + 1):
                    a, z = max(place, j * size), min(last + 1, (j + 1) * size)
                    common = body[min((j + 1) * size, width) - 1 - place : j * size + length - place]
                    part = body[a - place : z - place + length - 1]
                    group = xxh3_64_intdigest(common, seed=j * 4096 + size) - (1 << 63)
                    out.append((anchor, segment, off + a - place, group, xxh3_64_intdigest(part, seed=1) - (1 << 63), copies, a, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOCKS.types)], schema=BLOCKS)

    return rows.mapInArrow(tidy(cut), BLOCK_ROWS)


def _mark_large(bodies: DataFrame, length: int, shard: int, group_bytes: int) -> DataFrame:
    """The same for anchor groups over group_bytes, by finer and finer blocks."""
    size, rows, out = length - gram_size(length) + 1, bodies, []
    while True:
        size = -(-size // 2)
        larger, rows = rows, materialize(_halved(rows, length, size), "blocks")
        release(larger.sparkSession, larger)
        each = rows.groupBy("group", "block").agg(F.sum("copies").alias("copies"), F.min(F.octet_length("body")).alias("bytes"))
        groups = materialize(each.groupBy("group").agg(F.sum("copies").alias("copies"), F.sum("bytes").alias("bytes")).where("copies > 1"), "groups")
        large = (F.col("bytes") > group_bytes) & F.lit(size > 1)
        maybe, _ = parted(rows, ("group",), groups.select("group"))
        small = materialize(maybe.join(groups.where(~large).select("group"), "group", "left_semi"), "blocks")
        # One body of each block; its partial minima are taken before the shuffle.
        distinct = small.groupBy("group", "block").agg(F.sum("copies").alias("copies"), F.min("body").alias("body"))
        marks = _mark(distinct.select(F.col("group").alias("anchor"), F.col("block").alias("segment"), "copies", "body"), length, shard)
        marks = marks.select(F.col("anchor").alias("group"), F.col("segment").alias("block"), "begins", "ends")
        back = small.select("anchor", "segment", "off", "group", "block").join(marks, ["group", "block"])
        out.append(back.select("anchor", "segment", *[F.transform(c, lambda x: x + F.col("off")).alias(c) for c in ("begins", "ends")]))
        more = groups.where(large).select("group")
        if more.isEmpty():
            found = out[0]
            for m in out[1:]:
                found = found.unionByName(m)
            return found
        larger, rows = rows, materialize(maybe.join(more, "group", "left_semi").select(rows.columns), "blocks")
        release(larger.sparkSession, larger)


def repeated_spans(docs: DataFrame, length: int = 400, group_bytes: int = 1 << 18, shard: int = 1 << 19, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with keys _k1 and _k2 and text, spans per key as an array of (begin, end) that may overlap)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text")).select(*doc_keys(), "text")
    found = materialize(_segment_rows(d, length), "segments")
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "anchors")
    maybe, _ = parted(found, ("anchor",), shared)
    suspects = materialize(maybe.join(shared, "anchor", "left_semi"), "suspects")
    release(spark, found)
    release(spark, shared)
    # Copies are counted before the shuffle; the bytes come from one occurrence.
    place = F.struct("_k1", "_k2", "at", "windows")
    distinct = materialize(suspects.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("o")).select("anchor", "segment", "copies", "o.*"), "distinct")
    large = materialize(distinct.groupBy("anchor").agg(F.sum(F.col("windows") + (length - 1)).alias("_b")).where(F.col("_b") > group_bytes).select("anchor"), "large-groups")
    if large.isEmpty():
        marks = _mark(_cut(d, distinct, length), length, shard)
    else:
        # What the bit map takes for large goes through the same index by another route.
        big, small = parted(distinct, ("anchor",), large)
        marks = _mark(_cut(d, small, length), length, shard).unionByName(_mark_large(materialize(_cut(d, big, length), "bodies"), length, shard, group_bytes))
    each = suspects.select("_k1", "_k2", "at", "anchor", "segment").join(marks, ["anchor", "segment"])
    spans = F.transform(F.arrays_zip("begins", "ends"), lambda s: F.struct((F.col("at") + s["begins"]).alias("a"), (F.col("at") + s["ends"]).alias("z")))
    # A set: repeated rows have the same spans.
    out = materialize(each.select("_k1", "_k2", spans.alias("s")).groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("s")).alias("spans")), "spans")
    release(spark, suspects)
    release(spark, distinct)
    return d, out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs: touching spans are one."""
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", keep: bool = False, **more: int) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the spans). With keep, instead the
    columns of docs with the remaining text (bytes that no longer form a character are dropped) and, if there is one, its n_chars.
    Only texts that lose bytes are shuffled to meet their spans."""
    _, spans = repeated_spans(docs, length, doc_id=doc_id, text=text, **more)
    left = docs.select(*doc_keys(doc_id, text), F.struct(*([F.col(f"`{c}`") for c in docs.columns] if keep else [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")])).alias("row"))
    maybe, same = parted(left, ("_k1", "_k2"), spans.select("_k1", "_k2"))
    hit = maybe.join(spans, ["_k1", "_k2"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))])

    def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
        cuts = [0, *[x for r in runs for x in r], len(raw)]
        return b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2]))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for doc, raw, s in zip(b.column(2).to_pylist(), texts_of(b.column(0)), b.column(1).to_pylist()):
                runs = merged(s)
                rows.append((doc, len(raw), sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept(raw, runs)).hexdigest(), [{"a": a, "z": z} for a, z in runs]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row = b.column(2)
            names = [row.type.field(i).name for i in range(row.type.num_fields)]
            columns = dict(zip(names, row.flatten()))
            gone = [merged(s) for s in b.column(1).to_pylist()]
            if any(gone):
                new = [kept(raw, runs).decode("utf-8", "ignore") if runs else None for raw, runs in zip(texts_of(b.column(0)), gone)]
                changed = pa.array([bool(r) for r in gone])
                columns[text] = pc.if_else(changed, pa.array(new, columns[text].type), columns[text])
                if "n_chars" in columns:
                    columns["n_chars"] = pc.if_else(changed, pa.array([None if x is None else len(x) for x in new], columns["n_chars"].type), columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    if keep:
        return same.select("row.*").unionByName(hit.select(F.col(f"row.`{text}`").alias("text"), "spans", "row").mapInArrow(tidy(shorten), docs.schema))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    both = hit.select("row.text", "spans", "row.doc_id").unionByName(same.select("row.text", none.alias("spans"), "row.doc_id"))
    return both.mapInArrow(tidy(report), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:long,z:long>>")
