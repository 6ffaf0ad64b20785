"""Spelling: interpolated modified Kneser-Ney over byte classes, the base distribution of the word model.

A word is read as UTF-8 bytes in 64 classes (26 letters without case, digits, three groups of marks, control characters,
and 32 for bytes over 127, so that scripts and their letters differ; 0 is the border of a word). An n-gram of classes is a
number of 6 * n bits, which serves as its hash without collisions, so a model of order 3 has at most 2 ** 18 entries per
language whatever the size of the corpus, and may be broadcast.

A model needs only the counts of its highest order. Lower orders count the distinct left neighbours of their n-grams.
Each order has three discounts from its own counts of counts (for counts 1, 2, and 3 or more).
"""

from __future__ import annotations

import numpy as np

BITS = 6
CLASSES = 1 << BITS
ORDER = 3


def class_table() -> np.ndarray:
    """Byte -> class 1..63."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b).lower()
        if b >= 128:
            t[b] = 32 + (b & 31)
        elif "a" <= c <= "z":
            t[b] = 1 + ord(c) - 97
        elif c.isdigit():
            t[b] = 27
        elif c in ".,;:!?":
            t[b] = 28
        elif c in "'\"()-":
            t[b] = 29
        else:
            t[b] = 30 if b > 32 else 31
    return t


TABLE = class_table()


def codes(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram at every byte of every word and at its end, offsets of the words among these)."""
    n = np.diff(offsets)
    pad = order - 1
    at = np.arange(len(raw)) + np.repeat(np.arange(len(n)) * (pad + 1) + pad, n)
    x = np.zeros(len(raw) + len(n) * (pad + 1) + pad, np.uint8)
    x[at] = TABLE[raw]
    full = np.zeros(len(x) - pad, np.uint32)
    for k in range(order):
        full = full << np.uint32(BITS) | x[k : len(x) - pad + k]
    # Each word owns the n-grams that end at its bytes and at the border behind it; the rest belong to padding.
    own = n + 1
    begin = np.concatenate([[0], np.cumsum(n + pad + 1)])[:-1]
    index = np.arange(own.sum()) + np.repeat(begin - (np.cumsum(own) - own), own)
    return full[index], np.concatenate([[0], np.cumsum(own)])


def discounts(counts_of_counts: list[float]) -> np.ndarray:
    """Discount of counts 0, 1, 2, 3 and more, from how many n-grams have counts 1 to 4; 0.5 where these are too few."""
    n = counts_of_counts
    if min(n) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip(np.array([0.0] + [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


class Model:
    """Sorted n-gram hashes of every order with their interpolated log2 probabilities, and context hashes with the log2
    weight left for the lower order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        by_order: list[tuple[np.ndarray, np.ndarray]] = [(grams.astype(np.uint32), counts.astype(np.int64))]
        for k in range(order - 1, 0, -1):
            lower, n = np.unique(by_order[0][0] & np.uint32((1 << BITS * k) - 1), return_counts=True)
            by_order.insert(0, (lower, n))
        self.grams, self.logp, self.contexts, self.left = [], [], [], []
        below = np.full(CLASSES, 1 / CLASSES)
        for k, (g, c) in enumerate(by_order, 1):
            d = discounts([float((c == i).sum()) for i in range(1, 5)])
            context = g >> np.uint32(BITS)
            new = np.concatenate([[True], context[1:] != context[:-1]]) if len(g) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            owner = np.cumsum(new) - 1
            take = d[np.minimum(c, 3)]
            total = np.add.reduceat(c, start) if len(g) else np.zeros(0)
            weight = (np.add.reduceat(take, start) if len(g) else np.zeros(0)) / np.maximum(total, 1)
            if k == 1:
                base = below[g]
            else:
                base = np.exp2(self._lookup(k - 1, g & np.uint32((1 << BITS * (k - 1)) - 1)))
            p = (c - take) / total[owner] + weight[owner] * base if len(g) else np.zeros(0)
            self.grams.append(g)
            self.logp.append(np.log2(np.maximum(p, 1e-30)).astype(np.float32))
            self.contexts.append(context[start])
            self.left.append(np.log2(np.maximum(weight, 1e-30)).astype(np.float32))

    def _lookup(self, k: int, g: np.ndarray) -> np.ndarray:
        """log2 P of k-grams: stored, or the context's weight times the lower order."""
        if k == 0:
            return np.full(len(g), -BITS, np.float32)
        keys = self.grams[k - 1]
        out = np.zeros(len(g), np.float32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[hit] = self.logp[k - 1][at[hit]]
        else:
            hit = np.zeros(len(g), bool)
        miss = np.flatnonzero(~hit)
        if len(miss):
            h = g[miss] >> np.uint32(BITS)
            extra = np.zeros(len(miss), np.float32)
            contexts = self.contexts[k - 1]
            if len(contexts):
                c = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
                known = contexts[c] == h
                extra[known] = self.left[k - 1][c[known]]
            out[miss] = extra + self._lookup(k - 1, g[miss] & np.uint32((1 << BITS * (k - 1)) - 1))
        return out

    def log2p(self, g: np.ndarray) -> np.ndarray:
        """log2 P of each n-gram's last class, through a table of all n-grams, made at the first call."""
        if getattr(self, "_all", None) is None:
            self._all = self._lookup(self.order, np.arange(1 << BITS * self.order, dtype=np.uint32))
        return self._all[g]

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log2 P of each word's bytes and its border."""
        if not len(start):
            return np.zeros(0)
        g, places = codes(*gathered(raw, start, end), self.order)
        return np.add.reduceat(self.log2p(g).astype(np.float64), places[:-1])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_all"}


def gathered(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of raw[start : end] one after the other, and n + 1 offsets into them."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n)])
    return raw[np.arange(at[-1]) + np.repeat(start - at[:-1], n)], at
