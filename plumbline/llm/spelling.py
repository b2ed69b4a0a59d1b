"""Spelling: a modified Kneser-Ney model over symbols of words.

Words are sequences of symbols: the bytes of a word's UTF-8 text in 63 classes (see
classes()) and one symbol for its edges. The number of different n-grams is bounded by
64 ** ORDER however large the corpus is, so every worker holds the whole model.

The model is modified Kneser-Ney (Chen and Goodman): three discounts an order from
the counts of counts, raw counts for the highest order and for what starts at a
word's edge, numbers of left contexts for the rest, interpolated down to uniform. It
is stored in sorted arrays of n-gram hashes with their log probability and log
back-off weight; look-up is a binary search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plumbline.llm.words import BLANK

ORDER = 4
EDGE = 63


def classes() -> np.ndarray:
    """Class of each byte: a letter's own, one for capitals, one for digits, sixteen each for other ASCII, continuation and lead bytes (the last two share three)."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if ord("a") <= b <= ord("z"):
            out[b] = b - ord("a")
        elif ord("A") <= b <= ord("Z"):
            out[b] = 26
        elif ord("0") <= b <= ord("9"):
            out[b] = 27
        elif b < 0x80:
            out[b] = 28 + b % 16
        elif b < 0xC0:
            out[b] = 44 + b % 16
        else:
            out[b] = 60 + (b >> 2) % 3
    return out


CLASSES = classes()
SYMBOL = np.where(BLANK, EDGE, CLASSES).astype(np.int32)


def hashed(keys: np.ndarray) -> np.ndarray:
    """A mix of 64 bits without collisions, so equal hashes are equal n-grams."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of the highest order as numbers of 6 bits a symbol, where each word's begin, where they end).

    Each byte of a word is predicted, and the edge after it; symbols before the word are edges.
    """
    line = np.full(len(data) + ORDER, EDGE, np.int32)
    line[ORDER - 1 : -1] = SYMBOL[data]
    edge = np.ones(len(line), bool)
    edge[ORDER - 1 : -1] = BLANK[data]
    n = len(data) + 1
    key, before = line[ORDER - 1 :].copy(), np.zeros(n, bool)
    for back in range(1, ORDER):
        at = slice(ORDER - 1 - back, ORDER - 1 - back + n)
        before |= edge[at]
        key |= np.where(before, EDGE, line[at]) << 6 * back
    own = ~edge[ORDER - 1 :]
    own[end] = True
    place = np.cumsum(own) - 1
    return key[own].astype(np.int64), place[start], place[end] + 1


@dataclass
class Spelling:
    """hash, logp, backoff of each order from 1; backoff[n] belongs to the context of n symbols."""

    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each highest-order n-gram's last symbol."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for n in range(len(self.hashes), 0, -1):
            own = keys[todo] & ((1 << 6 * n) - 1)
            at, found = _look(self.hashes[n - 1], hashed(own))
            out[todo[found]] += self.logp[n - 1][at[found]]
            todo, own = todo[~found], own[~found]
            if not len(todo):
                return out
            at, found = _look(self.contexts[n - 1], hashed(own >> 6))
            out[todo[found]] += self.backoff[n - 1][at[found]]
        out[todo] += -np.log(64)
        return out


def _look(sorted_hashes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, asked), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == asked


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discount for counts 1, 2 and from 3; usual values where the counts of counts don't give any."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    if not all(n):
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.clip(d, 0.05, [0.95, 1.9, 2.8])


def estimate(keys: np.ndarray, counts: np.ndarray) -> Spelling:
    """The model of the counted n-grams of the highest order."""
    order = np.argsort(keys)
    raw = [None] * ORDER
    raw[ORDER - 1] = (keys[order].astype(np.int64), counts[order].astype(np.int64))
    for n in range(ORDER - 1, 0, -1):
        above, above_counts = raw[n]
        suffix = above & ((1 << 6 * n) - 1)
        own, back = np.unique(suffix, return_inverse=True)
        lefts = np.bincount(back, minlength=len(own))
        sums = np.zeros(len(own), np.int64)
        np.add.at(sums, back, above_counts)
        from_edge = own >> 6 * (n - 1) == EDGE
        raw[n - 1] = (own, np.where(from_edge & (n > 1), sums, lefts))
    model = Spelling([], [], [], [])
    lower_keys, lower_p = np.zeros(0, np.int64), np.zeros(0)
    for n in range(1, ORDER + 1):
        own, c = raw[n - 1]
        d = discounts(c)
        context, back = np.unique(own >> 6, return_inverse=True)
        total = np.bincount(back, weights=c, minlength=len(context))
        taken = d[np.minimum(c, 3) - 1]
        left = np.bincount(back, weights=taken, minlength=len(context)) / np.maximum(total, 1)
        if n == 1:
            below = np.full(len(own), 1 / 64)
        else:
            below = lower_p[np.searchsorted(lower_keys, own & ((1 << 6 * (n - 1)) - 1))]
        p = (c - taken) / total[back] + left[back] * below
        h, ch = hashed(own), hashed(context)
        s, cs = np.argsort(h), np.argsort(ch)
        model.hashes.append(h[s])
        model.logp.append(np.log(p)[s])
        model.contexts.append(ch[cs])
        model.backoff.append(np.log(left)[cs])
        lower_keys, lower_p = own, p
    return model
