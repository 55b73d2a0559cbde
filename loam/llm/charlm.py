"""Interpolated Kneser-Ney character models of words, one per label, side by side in sorted hash arrays.

A word is scored with a blank on either side. All labels share one table per order: a sorted array of n-gram hashes and
a matrix of log probabilities, in which an n-gram that a label lacks already holds that label's backed-off value. So a
lookup is one binary search per order for all labels at once.
"""

from __future__ import annotations

import numpy as np

#: Kneser-Ney discount, and the size of the alphabet that the last back-off spreads its mass over.
DISCOUNT, ALPHABET = 0.75, 4000.0
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ' word ' for all words in one array, and where each word begins."""
    flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 2 for w in words], out=starts[1:])
    return flat, starts


def _hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (the first n-1 positions hold nothing of use)."""
    h = np.zeros(len(flat), np.uint64)
    if n > len(flat):
        return h
    for k in range(n):
        h[n - 1 :] = h[n - 1 :] * _BASE + flat[k : len(flat) - n + 1 + k] + np.uint64(1)
    return (h ^ (h >> np.uint64(29))) * _MIX


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class _Single:
    """One label's model: per order the n-gram hashes, log probabilities, context hashes and back-off weights."""

    def __init__(self, counts: dict[str, float], order: int):
        words = [w for w in counts if w]
        weight = np.array([counts[w] for w in words], np.float64)
        flat, starts = _codes(words)
        which = np.repeat(np.arange(len(words)), np.diff(starts))
        offset = np.arange(len(flat)) - starts[which]
        hashes = {n: _hashes(flat, n) for n in range(1, order + 1)}
        self.grams, self.contexts, lower = {}, {}, None
        for n in range(1, order + 1):
            # An n-gram ending at offset o counts if it is whole (o >= n-1) and predicts a character (o >= 1).
            here = np.flatnonzero((offset >= max(n - 1, 1)))
            key, first, inverse = np.unique(hashes[n][here], return_index=True, return_inverse=True)
            end = here[first]
            count = np.bincount(inverse, weight[which[here]], len(key))
            if n < order:
                longer = here[offset[here] >= n]
                _, one = np.unique(hashes[n + 1][longer], return_index=True)
                distinct = np.bincount(np.searchsorted(key, hashes[n][longer[one]]), minlength=len(key)).astype(np.float64)
                count = np.where(offset[end] == n - 1, count, np.maximum(distinct, 1)) if n > 1 else np.maximum(distinct, 1)
            if n == 1:
                total, kinds = count.sum(), len(key)
                p = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * kinds / total / ALPHABET
                self.floor = float(np.log(DISCOUNT * kinds / total / ALPHABET)) if total else -np.log(ALPHABET)
            else:
                context, back = np.unique(hashes[n - 1][end - 1], return_inverse=True)
                mass, kinds = np.bincount(back, count), np.bincount(back)
                at, _ = _find(lower[0], hashes[n - 1][end])
                p = np.maximum(count - DISCOUNT, 0) / mass[back] + (DISCOUNT * kinds / mass)[back] * lower[1][at]
                self.contexts[n] = (context, np.log(np.minimum(DISCOUNT * kinds / mass, 1.0)))
            self.grams[n] = (key, np.log(p), hashes[n - 1][end - 1] if n > 1 else None, hashes[n - 1][end] if n > 1 else None)
            lower = (key, p)


class CharModels:
    """Models of several labels over words with counts; ``score`` gives a row of log probabilities a word."""

    def __init__(self, counts: dict[str, dict[str, float]], order: int = 5):
        self.labels, self.order = sorted(counts), order
        single = [_Single(counts[label] or {"?": 1.0}, order) for label in self.labels]
        self.floor = np.array([s.floor for s in single], np.float32)
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.context: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        for n in range(1, order + 1):
            if n > 1:
                context = np.unique(np.concatenate([s.contexts[n][0] for s in single]))
                backoff = np.zeros((len(context), len(single)), np.float32)
                for k, s in enumerate(single):
                    backoff[np.searchsorted(context, s.contexts[n][0]), k] = s.contexts[n][1]
                self.context[n], self.backoff[n] = context, backoff
            keys, first = np.unique(np.concatenate([s.grams[n][0] for s in single]), return_index=True)
            if n == 1:
                logp = np.tile(self.floor, (len(keys), 1))
            else:
                before = np.concatenate([s.grams[n][2] for s in single])[first]
                suffix = np.concatenate([s.grams[n][3] for s in single])[first]
                at, there = _find(self.context[n], before)
                logp = np.where(there[:, None], self.backoff[n][at], 0) + self.logp[n - 1][_find(self.keys[n - 1], suffix)[0]]
            for k, s in enumerate(single):
                logp[np.searchsorted(keys, s.grams[n][0]), k] = s.grams[n][1]
            self.keys[n], self.logp[n] = keys, logp.astype(np.float32)

    @classmethod
    def of_sums(cls, label: str, grams: dict[int, tuple], contexts: dict[int, tuple]) -> CharModels:
        """One label's model from what was counted elsewhere: per order the sorted hashes of n-grams with those of their
        contexts and suffixes and their Kneser-Ney counts; and the sorted contexts with the sum and the number of their
        n-grams, of which not all need be given. Of single characters all are given."""
        if not len(grams[1][0]):
            return cls({label: {}}, max(grams))
        self = cls.__new__(cls)
        self.labels, self.order = [label], max(grams)
        self.keys, self.logp, self.context, self.backoff = {}, {}, {}, {}
        p = np.zeros(0)
        for n in range(1, self.order + 1):
            key, before, suffix, count = grams[n]
            if n == 1:
                total, kinds = count.sum(), len(key)
                self.floor = np.array([np.log(DISCOUNT * kinds / total / ALPHABET)], np.float32)
                p = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * kinds / total / ALPHABET
            else:
                context, mass, kinds = contexts[n]
                at, lower = _find(context, before)[0], p[_find(self.keys[n - 1], suffix)[0]] if len(key) else p[:0]
                p = np.maximum(count - DISCOUNT, 0) / mass[at] + (DISCOUNT * kinds / mass)[at] * lower
                self.context[n], self.backoff[n] = context, np.log(np.minimum(DISCOUNT * kinds / mass, 1.0)).astype(np.float32)[:, None]
            self.keys[n], self.logp[n] = key, np.log(p).astype(np.float32)[:, None]
        return self

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (with its closing blank) under each label."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        flat, starts = _codes(words)
        offset = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
        at, there = _find(self.keys[1], _hashes(flat, 1))
        out = np.where(there[:, None], self.logp[1][at], self.floor)
        previous = _hashes(flat, 1)
        for n in range(2, self.order + 1):
            rows = np.flatnonzero(offset >= n - 1)
            h = _hashes(flat, n)
            at, there = _find(self.keys[n], h[rows])
            seen, context = rows[there], rows[~there]
            c, known = _find(self.context[n], previous[context - 1])
            out[context[known]] += self.backoff[n][c[known]]
            out[seen] = self.logp[n][at[there]]
            previous = h
        out[starts[:-1]] = 0
        return np.add.reduceat(out, starts[:-1], axis=0)
