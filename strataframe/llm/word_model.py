"""Word-pair interpolated modified Kneser-Ney over a whole corpus, in sorted hash arrays that Spark shards.

Three levels. Pairs: p(w | v) = (c - D(c)) / C(v) + left(v) q(w), c the count of "v w", C(v) that of v as a first word, with
three discounts D from the counts of counts. Continuation: q(w) = (N(w) - D(N(w))) / N + L s(w), N(w) the number of different
words before w, for all words with `least` of them or more, whatever the size of the corpus; L is the mass left over.
Spelling: s(w), the byte model of kneser_ney.py, trained on the same words.

The pair table grows with the corpus, so it is never broadcast. It goes to shards by ranges of the hash of the first word,
as packed messages: each slice of texts sends a shard its sorted pair hashes with the places in the slice of the documents
they occur in. A shard merges its messages, which gives the pair counts, and sends back a sum of log probabilities per
document; texts are not shuffled. Two jobs read the messages, one for the totals that all shards need (counts of counts,
continuation counts) and one for the sums: they run over one RDD, whose shuffle files serve both, since a
second shuffle or a written copy would double the disk. Tasks grow in number with the cluster, shards with the corpus: a
task reads its shards one after the other.

A word's predecessors lie in all shards. Frequent words have a place each in the totals; of the others every task sends its counts
to ranges of their hashes, which sum them. The sums are broadcast in three bytes a word, so the broadcast grows with the vocabulary.

A document's own occurrences do not vouch for it: its pairs are taken from its counts before they are looked up. Continuation
counts keep them, so words after fewer than `least` different ones, whose count may be the document's own, are left to spelling.

Hot groups: words and pairs that make up more than a quarter of a shard (at most 2^18 of each a language, found by lossy
counting) are split over further shards, words by the second word and pairs by document. Their totals are summed over
these shards and broadcast.

Defined results: null and empty texts have no words and no row; equal rows share a row, which sums them; very long texts
are one slice; words are told apart by 32 bits; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, release, slices, text_buffers, tidy
from .kneser_ney import BITS, ORDER, Model, codes, discounts, gathered

#: Least share of a language's words that makes a hot word or pair, or a frequent word; bounds the lists of these.
LEAST_SHARE = 2.0**-16
#: Ranges of hashes by which the continuation counts of the other words are summed, and how many a task holds before it sends them.
RANGE_BITS, HELD = 6, 1 << 20
#: Steps of a bit in which spelling probabilities are shipped.
STEPS = 4
#: Bytes of text whose words are found at once.
PIECE = 1 << 18
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
EXACT = np.arange(256, dtype=np.uint8)
FOLD = EXACT.copy()
FOLD[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64. Only a word of over PIECE bytes makes them longer than that."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _cuts(raw: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of about `most` bytes that end at the border of a text or, in a longer one, behind white space."""
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        z = min(a + most, end)
        if z < end:
            k = int(np.searchsorted(offsets, z, side="right")) - 1
            if offsets[k] > a:
                z = int(offsets[k])
            else:
                spaces = np.flatnonzero(_SPACE[raw[a:z]])
                if len(spaces):
                    z = a + int(spaces[-1]) + 1
                else:
                    ahead = np.flatnonzero(_SPACE[raw[z : offsets[k + 1]]])
                    z = z + int(ahead[0]) + 1 if len(ahead) else int(offsets[k + 1])
        yield a, z
        a = z


def words_of(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE, folds: tuple[np.ndarray, ...] = (FOLD,)) -> tuple[np.ndarray, ...]:
    """(start, end, text, 64-bit hash) of every word, a hash by each table of `folds`: without case, if none are given."""
    none = np.zeros(0, np.int64)
    out = [(none, none, *[none.astype(np.uint64)] * len(folds))]
    for a, z in _cuts(raw, offsets, most):
        part = raw[a:z]
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z, side="right")] - a] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _powers(len(part) + 1)
        hashes = []
        for fold in folds:
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[fold[part]] * up[: len(part)])])
                hashes.append(_mixed((sums[end] - sums[start]) * down[start]))
        out.append((start + a, end + a, *hashes))
    start, end, *hashes = (np.concatenate(x) for x in zip(*out))
    return start, end, np.searchsorted(offsets, start, side="right") - 1, *hashes


def short(h: np.ndarray) -> np.ndarray:
    """The 32 bits that stand for a word in pairs; 0 is the beginning of a text."""
    return np.maximum(h >> np.uint64(32), np.uint64(1))


def pairs_of(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of the word before (0 at the beginning of a text) and the word, as one number each."""
    v = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
    if len(h):
        v[np.concatenate([[True], text[1:] != text[:-1]])] = 0
    return v << np.uint64(32) | h


def by_language(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, rows, bytes of their texts, offsets) of a batch with columns lang and text."""
    raw, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
    langs = np.array(b.column(b.schema.get_field_index("lang")).to_pylist())
    for lang in np.unique(langs):
        rows = np.flatnonzero(langs == lang)
        if len(rows) == len(langs):
            yield str(lang), rows, raw, offsets
        else:
            at = np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])
            yield str(lang), rows, np.concatenate([raw[a:z] for a, z in zip(offsets[rows].tolist(), offsets[rows + 1].tolist())]), at


def pack(*arrays: np.ndarray) -> tuple[bytes, int]:
    """uint32 arrays as byte planes, compressed; with the size before compression."""
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    whole = head + b"".join(np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return pa.Codec("zstd", compression_level=3).compress(whole, asbytes=True), len(whole)


def unpack(data: bytes, size: int) -> list[np.ndarray]:
    whole = np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), np.uint8)
    count = int(whole[:4].view(np.uint32)[0])
    lengths = whole[4 : 4 + 4 * count].view(np.uint32).astype(np.int64)
    at, out = 4 + 4 * count, []
    for n in lengths:
        out.append(np.ascontiguousarray(whole[at : at + 4 * n].reshape(4, n).T).view(np.uint32).reshape(n))
        at += 4 * n
    return out


def steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences within consecutive runs of these sizes, whose first values stay."""
    begin = np.cumsum(sizes) - sizes
    out = np.diff(x, prepend=0)
    out[begin] = x[begin]
    return out


def unsteps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(x, dtype=np.int64)
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    return total - np.repeat(total[begin] - x[begin], sizes)


def split64(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.int64).view(np.uint64)
    return (x >> np.uint64(32)).astype(np.uint32), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def join64(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)).view(np.int64)


class Frequent:
    """Lossy counting: every item with more than `share` of the stream stays, its count short by half of that at most."""

    def __init__(self, share: float):
        self.least, self.seen = share / 4, 0
        self.keys, self.counts, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, keys: np.ndarray, counts: np.ndarray, seen: int) -> None:
        """Different keys with their counts in the next `seen` items."""
        often = counts >= self.least * seen
        many = np.concatenate([self.keys, keys[often]])
        before = np.concatenate([self.missed, np.full(often.sum(), self.least * self.seen)])  # what a new key may have lost
        self.keys, first, back = np.unique(many, return_index=True, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts[often]]), len(self.keys)).astype(np.int64)
        self.missed = before[first]
        self.seen += seen
        stay = self.counts + self.missed >= self.least * self.seen
        self.keys, self.counts, self.missed = self.keys[stay], self.counts[stay], self.missed[stay]


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `most` bytes of text each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(text_buffers(b.column(b.schema.get_field_index("text")))[0])
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Plan:
    """Where the pairs of one language go: `shards` from number `first` on, then those of hot words, then of hot pairs."""

    first: int
    shards: int
    words: np.ndarray  # hot words, sorted, and into how many shards each is split
    word_parts: np.ndarray
    pairs: np.ndarray
    pair_parts: np.ndarray
    frequent: np.ndarray  # words whose different predecessors are counted with the totals, sorted
    taught: int  # words that teach
    model: Model

    @property
    def end(self) -> int:
        return self.first + self.shards + int(self.word_parts.sum() + self.pair_parts.sum())

    def shard_of(self, key: np.ndarray, row: np.ndarray) -> np.ndarray:
        v, w = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        shard = (v * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        at, hit = found(self.words, v)
        base = self.shards + np.concatenate([[0], np.cumsum(self.word_parts)])
        shard[hit] = base[at[hit]] + (_mixed(w[hit]) % self.word_parts[at[hit]].astype(np.uint64)).astype(np.int64)
        at, hit = found(self.pairs, key)
        first = base[-1] + np.concatenate([[0], np.cumsum(self.pair_parts)])
        shard[hit] = first[at[hit]] + (_mixed(row[hit].view(np.uint64)) % self.pair_parts[at[hit]].astype(np.uint64)).astype(np.int64)
        return shard + self.first


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, whether it is there)"""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def survey(d: DataFrame, shard_bytes: int, slice_bytes: int) -> dict[str, Plan]:
    """One pass over d (row, lang, text, teaches) for what is broadcast: spelling counts of the texts that teach, and the
    frequent words and pairs of all."""
    sizes = {r.lang: max(1, -(-r.n // shard_bytes)) for r in d.groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()}
    share = {lang: max(1 / (4 * n), LEAST_SHARE) for lang, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], Frequent] = {}
        grams: dict[str, np.ndarray] = {}
        for b in joined(slices(batches, "text", slice_bytes), slice_bytes):
            teaches = b.column(3).to_numpy(zero_copy_only=False)
            for lang, rows, raw, offsets in by_language(b):
                start, end, text, h = words_of(raw, offsets)
                if not len(h):
                    continue
                h = short(h)
                one, place, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                use = teaches[rows][text]
                taught = count if use.all() else np.bincount(inverse[use], minlength=len(one))
                some = np.flatnonzero(taught)
                g, at = codes(*gathered(raw, start[place[some]], end[place[some]]))
                grams[lang] = grams.get(lang, 0) + np.bincount(g, np.repeat(taught[some], np.diff(at)), 1 << BITS * ORDER).astype(np.int64)
                counted.setdefault((lang, "level"), Frequent(LEAST_SHARE)).add(one[some], taught[some], int(taught.sum()))
                words, pairs = (counted.setdefault((lang, kind), Frequent(share[lang])) for kind in ("word", "pair"))
                # A pair is no more frequent than its words.
                often = (count >= pairs.least * len(h))[inverse]
                often &= np.concatenate([[True], text[1:] != text[:-1]]) | np.concatenate([[False], often[:-1]])
                words.add(one, count, len(h))
                pairs.add(*np.unique(pairs_of(text, h)[often], return_counts=True), len(h))
        for (lang, kind), c in counted.items():
            k = np.concatenate([c.keys.view(np.int64), [-1]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array([kind] * (len(k) - 1) + ["all " + kind]), pa.array(k), pa.array(np.concatenate([c.counts, [c.seen]]))], names=["lang", "kind", "key", "n"])
        for lang, c in grams.items():
            g = np.flatnonzero(c)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(["gram"] * len(g)), pa.array(g), pa.array(c[g])], names=["lang", "kind", "key", "n"])

    t = materialize(d.mapInArrow(tidy(run), "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "survey")
    # At most 8 / share words and pairs a language, 2 ** 18 n-grams.
    bar = F.element_at(F.create_map(*[F.lit(x) for k, x in (share or {"": 1.0}).items() for x in (k, x / 2)]), F.col("lang"))
    least = F.when(F.col("kind") == "level", F.lit(LEAST_SHARE / 2)).otherwise(bar)
    seen = t.where("kind like 'all %'").select(F.col("lang").alias("_l"), F.expr("substr(kind, 5)").alias("_k"), F.col("n").alias("seen"))
    often = t.join(F.broadcast(seen), (F.col("lang") == F.col("_l")) & (F.col("kind") == F.col("_k")), "left").where(F.coalesce(F.col("n") >= F.col("seen") * least, F.lit(True)))
    rows = often.select("lang", "kind", "key", "n", F.coalesce("seen", F.lit(1)).alias("seen")).toArrow()
    release(d.sparkSession, t)
    lang_of, kind_of = (np.array(rows.column(i).to_pylist(), object) for i in (0, 1))
    key_of, n_of, seen_of = (rows.column(i).to_numpy() for i in (2, 3, 4))
    out, first = {}, 0
    for lang, n in sorted(sizes.items()):

        def of(kind: str, lang: str = lang) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero((lang_of == lang) & (kind_of == kind))
            at = at[np.argsort(key_of[at].view(np.uint64))]
            return key_of[at].view(np.uint64), n_of[at], n_of[at] / seen_of[at]

        (words, _, part), (pairs, _, pair_part), (grams, counts, _), (_, taught, _) = of("word"), of("pair"), of("gram"), of("all level")
        # A hot pair's first word is a hot word.
        hot_words, at = np.unique(np.concatenate([words, pairs >> np.uint64(32)]), return_index=True)
        hot_part = np.concatenate([part, pair_part])[at]
        parts = [np.maximum(1, np.rint(2 * n * x)).astype(np.int64) for x in (hot_part, pair_part)]
        # A hot pair counts once as a predecessor, however many shards it is split over, so its second word has to be among the frequent.
        frequent = np.union1d(of("level")[0], pairs & np.uint64(0xFFFFFFFF))
        out[lang] = Plan(first, n, hot_words, parts[0], pairs, parts[1], frequent, int(taught.sum()), Model(grams, counts))
        first = out[lang].end
    return out


def messages(plan: Plan, raw: np.ndarray, offsets: np.ndarray, row: np.ndarray, teaches: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(shard, packed pairs, size) of one slice of one language."""
    start, end, text, h = words_of(raw, offsets)
    if not len(h):
        return
    h = short(h)
    vocabulary, place = np.unique(h, return_index=True)
    spelling = np.round(-STEPS * plan.model.words(raw, start[place], end[place])).astype(np.int64)
    del start, end
    key = pairs_of(text, h)
    order = np.argsort(key, kind="stable")
    key, text = key[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key, text = key[first], text[first]
    shard = plan.shard_of(key, row[text])
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    doc = text * 2 + teaches[text]
    for a, z in zip(cuts[:-1], cuts[1:]):
        s = order[a:z]
        v, v_count = np.unique(key[s] >> np.uint64(32), return_counts=True)
        w, w_at = np.unique(key[s] & np.uint64(0xFFFFFFFF), return_inverse=True)
        data, size = pack(np.diff(v, prepend=0), v_count, np.diff(w, prepend=0), spelling[np.searchsorted(vocabulary, w)], steps(w_at, v_count), doc[s], count[s])
        yield int(shard[order[a]]), data, size


def merged(parts: list[tuple[int, int, bytes]], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """The messages (slice, size, data) of one shard by ranges of first words with about `most` uses each, so that memory is
    little more than the unpacked messages. Per pair its hash, spelling, taught count and uses; per use the message, the
    place of its document, its count and whether it teaches."""
    held = []
    for _, size, data in parts:
        v, v_count, w, spelling, w_at, doc, count = unpack(data, size)
        held.append((np.cumsum(v, dtype=np.uint64), np.concatenate([[0], np.cumsum(v_count, dtype=np.int64)]), np.cumsum(w, dtype=np.uint64), spelling, unsteps(w_at, v_count).astype(np.uint32), doc, count))
    every = np.concatenate([h[0] for h in held])
    order = np.argsort(every)
    run = np.cumsum(np.concatenate([np.diff(h[1]) for h in held])[order])
    every = every[order]
    # A range begins at the first word with which the uses exceed the next multiple of `most`.
    cuts = np.unique(every[np.searchsorted(run, np.arange(most, int(run[-1]), most))]) if len(run) else every
    del order, run, every
    lows, highs = [np.uint64(0), *cuts], [*cuts, np.uint64(1 << 32)]
    for low, high in zip(lows, highs):
        keys, spellings, docs, counts, owners = [], [], [], [], []
        for i, (v, at, w, spelling, w_at, doc, count) in enumerate(held):
            a, z = np.searchsorted(v, [low, high])
            if a == z:
                continue
            own = slice(int(at[a]), int(at[z]))
            second = w_at[own]
            keys.append(np.repeat(v[a:z], np.diff(at[a : z + 1])) << np.uint64(32) | w[second])
            spellings.append(spelling[second])
            docs.append(doc[own])
            counts.append(count[own])
            owners.append(np.full(own.stop - own.start, i, np.uint32))
        if not keys:
            continue
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        spelling, doc, count, owner = (np.concatenate(x)[order] for x in (spellings, docs, counts, owners))
        del order, keys, spellings, docs, counts, owners
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, teaches = count.astype(np.int32), (doc & 1).astype(np.int32)
        taught = np.add.reduceat(count * teaches, first, dtype=np.int64)
        yield key[first], spelling[first], taught, np.diff(np.concatenate([first, [len(key)]])), owner, doc >> 1, count, teaches


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, and the sums of their counts."""
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, back = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    return w, np.bincount(back, np.concatenate([c[1] for c in counts]), len(w)).astype(np.int64)


def partial_totals(plan: Plan, parts: list[tuple[int, int, bytes]]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of one shard (counts of counts; per hot word its total and how many pairs have counts 1, 2, and 3 or more; counts of
    hot pairs; different words before each frequent word; different pairs: sizes depend on the plan alone) and (all other
    words, how many different ones are before each)."""
    others: list[tuple[np.ndarray, np.ndarray]] = []
    few, different = np.zeros(4, np.int64), np.zeros(1, np.int64)
    words, pairs, before = np.zeros((len(plan.words), 4), np.int64), np.zeros(len(plan.pairs), np.int64), np.zeros(len(plan.frequent), np.int64)
    for unique, _, taught, *_ in merged(parts):
        unique, taught = unique[taught > 0], taught[taught > 0]
        at, is_pair = found(plan.pairs, unique)
        pairs[at[is_pair]] += taught[is_pair]
        unique, taught = unique[~is_pair], taught[~is_pair]
        few += [(taught == k).sum() for k in range(1, 5)]
        at, hit = found(plan.words, unique >> np.uint64(32))
        words += np.stack([np.bincount(at[hit], x[hit], len(plan.words)) for x in (taught, taught == 1, taught == 2, taught > 2)], 1).astype(np.int64)
        w = unique & np.uint64(0xFFFFFFFF)
        at, hit = found(plan.frequent, w)
        before += np.bincount(at[hit], minlength=len(plan.frequent))
        others.append(np.unique(w[~hit], return_counts=True))
        different += len(unique)
    return [few, words, pairs, before, different], summed(others)


class Counts:
    """Words of 32 bits, sorted, with their counts, in three bytes each: the lower half of a word, found by binary search in
    the run of its upper half, and a count, which is looked up in a list of its own from 255 on."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.begin = np.searchsorted(words, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(16))
        self.low = (words & np.uint64(0xFFFF)).astype(np.uint16)
        self.small = np.minimum(counts, 255).astype(np.uint8)
        self.many, self.many_counts = words[counts >= 255], counts[counts >= 255]
        self.steps = int(np.diff(self.begin).max()).bit_length()

    def of(self, w: np.ndarray) -> np.ndarray:
        """Counts of words; 0 for those not here."""
        out = np.zeros(len(w), np.int64)
        if not len(self.low) or not len(w):
            return out
        upper, x = (w >> np.uint64(16)).astype(np.int64), (w & np.uint64(0xFFFF)).astype(np.uint16)
        low, end = self.begin[upper], self.begin[upper + 1]
        high, last = end, len(self.low) - 1
        for _ in range(self.steps):
            mid = (low + high) >> 1
            less = (low < high) & (self.low[np.minimum(mid, last)] < x)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        hit = np.flatnonzero((low < end) & (self.low[np.minimum(low, last)] == x))
        out[hit] = self.small[low[hit]]
        large = np.flatnonzero(out == 255)
        out[large] = self.many_counts[found(self.many, w[large])[0]]
        return out


@dataclass
class Known:
    """What the shards of one language share: discounts, totals of hot words and pairs, and the continuation level."""

    discounts: np.ndarray
    words: np.ndarray
    word_totals: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    level: np.ndarray  # frequent words of the continuation level, sorted
    mass: np.ndarray
    others: Counts  # different words before each other word of that level
    different: int
    left: float
    model: Model

    def lower(self, w: np.ndarray, log2_spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass at the continuation level, log2 of it with the spelling's share) of words."""
        at, hit = found(self.level, w)
        mass = np.zeros(len(w))
        mass[hit] = self.mass[at[hit]]
        other = np.flatnonzero(~hit)
        before = self.others.of(w[other])
        mass[other] = (before - self.discounts[np.minimum(before, 3)]) / self.different
        rest = np.log2(self.left) + log2_spelled
        return mass, np.logaddexp2(np.where(mass > 0, np.log2(np.maximum(mass, 1e-300)), -np.inf), rest)


def known_of(plan: Plan, totals: list[np.ndarray], others: tuple[np.ndarray, np.ndarray], least: int) -> Known:
    """others: the words that are not frequent, sorted, with `least` different words before them or more, and how many."""
    few, words, pairs, before, different = totals
    words, before = words.copy(), before.copy()
    taught = pairs > 0  # pairs split by document count as one
    few = few + [int((pairs == k).sum()) for k in range(1, 5)]
    d = discounts(few.tolist())
    at, _ = found(plan.words, plan.pairs >> np.uint64(32))
    np.add.at(words, at, np.stack([pairs, pairs == 1, pairs == 2, pairs > 2], 1).astype(np.int64))
    at, hit = found(plan.frequent, plan.pairs & np.uint64(0xFFFFFFFF))
    np.add.at(before, at[hit & taught], 1)
    n = max(int(different[0] + taught.sum()), 1)
    level = before >= least
    mass = (before[level] - d[np.minimum(before[level], 3)]) / n
    rest = float((others[1] - d[np.minimum(others[1], 3)]).sum()) / n
    return Known(d, plan.words, words, plan.pairs, pairs, plan.frequent[level], mass, Counts(*others), n, max(1 - float(mass.sum()) - rest, 1e-9), plan.model)


def sums(known: Known, parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, places of documents, sums of log2 P, words) of the messages of one shard."""
    d, found_in = known.discounts, [([], [], []) for _ in parts]
    for key, spelling, taught, uses, message, doc, count, teaches in merged(parts):
        v = key >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(v)]])))
        stats = np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (taught, taught == 1, taught == 2, taught > 2)], 1)
        at, hit = found(known.words, v[first])
        stats[hit] = known.word_totals[at[hit]]
        at, hit = found(known.pairs, key)
        taught[hit] = known.pair_counts[at[hit]]
        total, taken = stats[owner, 0], (stats[:, 1:] @ d[1:])[owner]
        lower = known.lower(key & np.uint64(0xFFFFFFFF), spelling.astype(np.float64) / -STEPS)[1]
        pair = np.repeat(np.arange(len(key)), uses)
        own = count * teaches
        n = taught[pair]
        c, rest = n - own, total[pair] - own
        take = d[np.minimum(c, 3)]
        left = np.minimum(1.0, np.where(rest > 0, (taken[pair] - d[np.minimum(n, 3)] + take) / np.maximum(rest, 1), 1.0))
        seen = (c - take) / np.maximum(rest, 1)
        # In logarithms, since a long word's spelling is too improbable for a double.
        logp = np.logaddexp2(np.where(seen > 0, np.log2(np.maximum(seen, 1e-300)), -np.inf), np.log2(np.maximum(left, 1e-9)) + lower[pair]) * count
        order = np.argsort(message, kind="stable")
        cuts = np.searchsorted(message[order], np.arange(len(parts) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            some = order[cuts[i] : cuts[i + 1]]
            places, at = np.unique(doc[some], return_inverse=True)
            for held, x in zip(found_in[i], (places, np.bincount(at, logp[some]), np.bincount(at, count[some]).astype(np.int64))):
                held.append(x)
    for (one, _, _), held in zip(parts, found_in):
        if held[0]:
            places, at = np.unique(np.concatenate(held[0]), return_inverse=True)
            yield one, places.astype(np.int64), *(np.bincount(at, np.concatenate(x)) for x in held[1:])


def _added(a: dict, b: dict) -> dict:
    return {k: [x + y for x, y in zip(a[k], b[k])] if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}


def word_scores(d: DataFrame, shard_bytes: int = 12 << 20, slice_bytes: int = 4 << 20, least: int = 4) -> tuple[DataFrame, Broadcast]:
    """((row, log2p, words) of every text with a word, the shared part of the model by language), where d has row, lang, text and
    teaches. Words after fewer than `least` different ones are left to spelling: with 1 a document that teaches would vouch for its rare words."""
    spark = d.sparkSession
    plans = survey(d, shard_bytes, slice_bytes // 2)
    langs = sorted(plans)
    firsts = [plans[x].first for x in langs]
    total = max([1, *(p.end for p in plans.values())])
    tasks = min(total, max(64, 16 * spark.sparkContext.defaultParallelism))
    plan_of = spark.sparkContext.broadcast(plans)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(slices(batches, "text", slice_bytes), slice_bytes):
            flags, rows = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), b.column(0).to_numpy(zero_copy_only=False)
            for lang, own, raw, offsets in by_language(b):
                out = list(messages(plan_of.value[lang], raw, offsets, rows[own], flags[own]))
                if out:
                    # The name of the slice follows from its rows; numbers over those of shards take the rows behind their places.
                    name = int(np.bitwise_xor.reduce(_mixed(rows[own].view(np.uint64) + np.arange(len(own), dtype=np.uint64))).view(np.int64))
                    out.append((total + name % total, *pack(*split64(rows[own]))))
                    to, data, size = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([name] * len(to), pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["to", "slice", "size", "data"])

    def by_shard(rows: Iterator) -> Iterator[tuple[str, int, list[tuple[int, int, bytes]]]]:
        for to, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield langs[min(bisect.bisect_right(firsts, to), len(langs)) - 1], to, [(r[1], r[2], bytes(r[3])) for r in group]

    rows = d.mapInArrow(tidy(send), "to long, slice long, size long, data binary").repartitionById(tasks, (F.col("to") % tasks).cast("int")).sortWithinPartitions("to")

    buckets = -(-tasks // max(1, int(tasks**0.5)))

    def first(rows: Iterator) -> Iterator[tuple[int, int, bytes]]:
        """(key, size, packed) of a task: totals under keys below 0, a bucket of tasks each, and continuation counts by range of words."""
        out: dict[str, list[np.ndarray]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def ranges(lang: str) -> Iterator[tuple[int, int, bytes]]:
            w, n = held.pop(lang)
            cuts = np.searchsorted(w, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(32 - RANGE_BITS))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[k], cuts[k + 1])
                data, size = pack(np.diff(w[own], prepend=0), n[own])
                yield langs.index(lang) << RANGE_BITS | k, size, data

        for lang, to, parts in by_shard(rows):
            if to < total:
                own, others = partial_totals(plan_of.value[lang], parts)
                out = _added(out, {lang: own})
                held[lang] = summed([held[lang], others]) if lang in held else others
                if len(held[lang][0]) > HELD:
                    yield from ranges(lang)
        for lang in list(held):
            yield from ranges(lang)
        bucket = TaskContext.get().partitionId() % buckets
        for lang, x in out.items():
            data, size = pack(*split64(np.concatenate([a.reshape(-1) for a in x])))
            yield -1 - (langs.index(lang) * buckets + bucket), size, data

    def gather(t: pa.Table) -> pa.Table:
        """The packed rows of one key summed to one; what a key has is bounded by tasks for totals, by a share of the vocabulary for words."""
        key = t.column("key")[0].as_py()
        parts = [unpack(data, size) for size, data in zip(t.column("size").to_pylist(), t.column("data").to_pylist())]
        if key < 0:
            data, size = pack(*split64(sum(join64(*x) for x in parts)))
        else:
            w, n = summed([(np.cumsum(x[0], dtype=np.uint64), x[1]) for x in parts])
            some = n >= least
            data, size = pack(np.diff(w[some], prepend=0), n[some])
        return pa.table({"key": pa.array([key], pa.int64()), "size": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

    with carried(spark):
        sent = rows.rdd  # adaptive execution runs its first stage here
    counted = spark.createDataFrame(sent.mapPartitions(tidy(first)), "key long, size long, data binary", verifySchema=False)
    counted = counted.groupBy("key").applyInArrow(gather, "key long, size long, data binary").toArrow().sort_by("key").to_pydict()
    totals: dict[str, np.ndarray] = {}
    others: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for key, size, data in zip(*counted.values()):
        x = unpack(data, size)
        if key < 0:
            lang = langs[(-1 - key) // buckets]
            totals[lang] = totals.get(lang, 0) + join64(*x)
        else:
            others.setdefault(langs[key >> RANGE_BITS], []).append((np.cumsum(x[0], dtype=np.uint64), x[1]))
    known_by = {}
    for lang, x in totals.items():
        plan = plans[lang]
        ends = np.cumsum([4, 4 * len(plan.words), len(plan.pairs), len(plan.frequent)])
        few, words, pairs, before, different = np.split(x, ends)
        rare = others.pop(lang, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
        rare = tuple(np.concatenate([a[i] for a in rare]).astype((np.uint64, np.int64)[i]) for i in range(2))
        known_by[lang] = known_of(plan, [few, words.reshape(-1, 4), pairs, before, different], rare, least)
    known = spark.sparkContext.broadcast(known_by)

    def second(rows: Iterator) -> Iterator[tuple]:
        for lang, to, parts in by_shard(rows):
            if to < total:
                for name, places, log2p, words in sums(known.value[lang], parts):
                    data, size = pack(places, log2p.astype(np.float32).view(np.uint32), words)
                    yield name, False, size, data
            else:
                for name, size, data in parts:
                    yield name, True, size, data

    def fold(t: pa.Table) -> pa.Table:
        """The rows of one slice with their sums over all shards; what a slice has of these is bounded by its words."""
        parts = [(n, unpack(data, size)) for n, size, data in zip(*(t.column(c).to_pylist() for c in ("names", "size", "data")))]
        row = join64(*next(x for n, x in parts if n))
        log2p, words = np.zeros(len(row)), np.zeros(len(row), np.int64)
        for named, x in parts:
            if not named:
                log2p[x[0]] += x[1].view(np.float32)
                words[x[0]] += x[2]
        some = words > 0
        return pa.table({"row": row[some], "log2p": log2p[some], "words": words[some]})

    packed = spark.createDataFrame(sent.mapPartitions(tidy(second)), "slice long, names boolean, size long, data binary", verifySchema=False)
    return packed.groupBy("slice").applyInArrow(fold, "row long, log2p double, words long").groupBy("row").agg(F.sum("log2p").alias("log2p"), F.sum("words").alias("words")), known
