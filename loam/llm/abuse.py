"""Problem 9: a score for abusive, hateful or sexual content per document, and the rate per source.

A bidirectional gated recurrent network with attention pooling, written and trained in numpy. Its input at each word is a
word vector and the mean of the vectors of the word's character n-grams, after undoing disguises (letters apart, signs for
letters, letters of another script, hidden characters). Every text is cut into overlapping windows of words, over the ends
of sentences, and each sentence into such windows as well; all are scored, and a document has the score of its worst one.
A worker scores each distinct window once.
"""

from __future__ import annotations

import ctypes
import glob
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.abuse_seeds import ALIKE, seed_sentences
from loam.llm.sampling import bounded_sample
from loam.session import spread

#: Words a window has and the step from one to the next.
WINDOW, STEP = 20, 10
#: Hash buckets for words and n-grams; sizes of their vectors, of the states of either direction and of the attention.
BUCKETS, WORD_DIM, CHAR_DIM, STATE, ATTEND = 8192, 12, 20, 16, 12
#: Bounds of the fitted sample: reviewed documents, other documents, seed sentences; and the number of training steps.
REVIEWED, OTHERS, SEEDS, STEPS, BATCH = 6_000, 3_000, 7_000, 900, 192
#: How often windows are labelled anew while the network is trained.
ROUNDS = 6
#: Abusive documents from which on the odds of words are used; share of documents from which on a word is common.
ENOUGH, COMMON = 30, 0.003
#: Word odds from which on a window of a document reviewed as abusive is taken to be why.
TELLING = 1.5
#: Every how many reviewed documents one is held out, the scores tried on them as the least of an abusive document, and the
#: number of those reviewed as abusive that it takes; with fewer the last score holds.
HELD, THRESHOLDS, TELLING_HELD = 6, (0.5, 0.6, 0.7, 0.8, 0.9), 10
#: Windows scored at once: as many as keep their states within a core's cache.
SCORED = 512
#: Words and windows a worker remembers.
MEMO_WORDS, MEMO_WINDOWS = 300_000, 600_000

_HIDDEN = re.compile(r"[​-‏⁠­﻿‪-‮︎️]")
_APART = re.compile(r"^\W*\w(?:([.\-_*·~|])\w)(?:\1\w)+\W*$")
_ENDS = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_INSIDE = re.compile(r"(?<=[^\W\d_])[*#_%~^&+]+(?=[^\W\d_])")
_SIGNS = str.maketrans({"@": "a", "$": "s", "€": "e", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"})
_TO_CYRILLIC = {k: v for k, v in ALIKE.items()}
_TO_LATIN = {v: k for k, v in ALIKE.items()}
_SPLICED = re.compile(r"(?<=[^\W\d_])[@$€0134578!]+(?=[^\W\d_])")


def plain_word(token: str) -> str:
    """A token as the word it is meant to be: lower case, disguises undone; '' where it has no letter."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", _HIDDEN.sub("", token))
    if _APART.match(token):
        token = re.sub(r"[\W_]", "", token)
    if not token.isascii():
        cyrillic = sum("Ѐ" <= c <= "ӿ" for c in token)
        latin = sum(c.isascii() and c.isalpha() for c in token)
        if cyrillic and latin:
            table = _TO_CYRILLIC if cyrillic >= latin else _TO_LATIN
            token = "".join(table.get(c, c) for c in token)
    token = token.lower().strip("\"'.,;:!?…()[]{}<>«»„“”‘’–—-*`|/\\")
    if not any(c.isalpha() for c in token):
        return ""
    if not token.isalpha():
        token = _SPLICED.sub(lambda m: m.group().translate(_SIGNS), token)
        token = _INSIDE.sub("*", token)
        token = re.sub(r"\d+", "0", token)
    if len(token) > 3:
        token = re.sub(r"([^\W\d_])\1{2,}", r"\1", token)
    return token


def _one_thread() -> None:
    """Keep numpy's linear algebra to one thread where its library allows: the matrices here are too small for more."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        try:
            ctypes.CDLL(path).scipy_openblas_set_num_threads64_(1)
        except (OSError, AttributeError):
            continue


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % BUCKETS


class Vocabulary:
    """Words met so far: numbers by token, and the hash buckets of each word and its n-grams. Word 0 is no word."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.tokens: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.word_bucket: list[int] = [0]
        self.grams: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.letter: list[str] = [""]

    def word(self, word: str) -> int:
        k = self.words.get(word)
        if k is None:
            k = self.words[word] = len(self.word_bucket)
            self.word_bucket.append(_bucket(word))
            framed = f"^{word}$"
            self.grams.append(np.array([_bucket(framed[i : i + n]) for n in (3, 4) for i in range(max(1, len(framed) - n + 1))], np.int64))
            self.letter.append(word if len(word) == 1 else "")
        return k

    def token(self, token: str) -> int:
        """Number of the token's word, doubled; one more if it ends a sentence."""
        k = self.tokens[token] = 2 * self.word(plain_word(token)) + (_ENDS.search(token) is not None)
        return k

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts and the unit (sentence) each belongs to, plus the text of each unit's first word."""
        get, new = self.tokens.get, self.token
        coded, lengths = [], []
        for text in texts:
            # A quoted cell of a delimited line begins a word of its own.
            tokens = text.replace(',"', " ").replace(';"', " ").split() if text else ()
            found = list(map(get, tokens))
            if None in found:
                found = [new(t) if (k := get(t)) is None else k for t in tokens]
            coded += found
            lengths.append(len(found))
        code = np.array(coded, np.int64)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        return code, text_of


class Windows:
    """Windows of word numbers, padded with 0, the text each is from, and whether it runs over the end of a sentence."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str | None]):
        code, text_of = vocabulary.numbers(texts)
        word, ends = code // 2, code % 2 == 1
        self._join_letters(vocabulary, word, text_of)
        before = np.r_[False, ends[:-1] | (text_of[1:] != text_of[:-1])] if len(word) else np.zeros(0, bool)
        unit = np.cumsum(before)
        keep = word > 0
        word, unit, text_of = word[keep], unit[keep], text_of[keep]
        if not len(word):
            self.rows, self.text, self.across = np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            return
        start, end = self._cut(unit)
        over, over_end = self._cut(text_of)
        across = unit[over] != unit[over_end - 1]  # one within a sentence is a part of the sentence's own
        self.across = np.repeat([False, True], [len(start), across.sum()])
        start, end = np.r_[start, over[across]], np.r_[end, over_end[across]]
        place = start[:, None] + np.arange(WINDOW)
        self.rows = np.where(place < end[:, None], word[np.minimum(place, len(word) - 1)], 0)
        self.text = text_of[start]

    @staticmethod
    def _cut(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the windows of each run of equal numbers; the last window may be shorter."""
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        length = np.diff(np.r_[first, len(run)])
        many = np.maximum(1, -(-(length - WINDOW) // STEP) + 1)
        start = np.repeat(first, many) + STEP * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        return start, np.minimum(start + WINDOW, np.repeat(first + length, many))

    @staticmethod
    def _join_letters(vocabulary: Vocabulary, word: np.ndarray, text_of: np.ndarray) -> None:
        """A run of three or more single letters becomes one word at its first place."""
        single = np.array([bool(x) for x in vocabulary.letter])[word] if len(word) else np.zeros(0, bool)
        if not single.any():
            return
        edge = np.flatnonzero(np.diff(np.r_[0, single.astype(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= 3 and text_of[a] == text_of[b - 1]:
                word[a] = vocabulary.word("".join(vocabulary.letter[k] for k in word[a:b]))
                word[a + 1 : b] = 0


def _scatter(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by index."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, values.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _row_keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


class Network:
    """The network's parameters, its scores, and its gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, STATE
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (0.1 * rng.standard_normal((BUCKETS, WORD_DIM))).astype(np.float32), "char": (0.3 * rng.standard_normal((BUCKETS, CHAR_DIM))).astype(np.float32),
            "wf": normal(d, 3 * h), "uf": normal(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "wb": normal(d, 3 * h), "ub": normal(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
            "att": normal(2 * h, ATTEND), "v": normal(ATTEND), "out": normal(2 * h), "b": np.full(1, -1.0, np.float32),
        }

    def inputs(self, word_bucket: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(g) for g in grams], np.float32)
        flat = np.concatenate(grams)
        starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        return np.concatenate([self.p["word"][word_bucket], np.add.reduceat(self.p["char"][flat], starts, axis=0) / sizes[:, None]], axis=1)

    def _run(self, z: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
        """States over time for inputs z (time, batch, 3h); a masked step leaves the state as it was."""
        steps, n, h = len(z), z.shape[1], STATE
        state, states, saved = np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32), []
        for t in range(steps):
            a = state @ u
            gates = _sigmoid(z[t, :, : 2 * h] + a[:, : 2 * h])
            r, k = gates[:, :h], gates[:, h:]
            c = np.tanh(z[t, :, 2 * h :] + r * a[:, 2 * h :])
            new = c + k * (state - c)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, state)
            if keep:
                saved.append((state, r, k, c, a[:, 2 * h :]))
            state = states[t] = new
        return states, saved

    def forward(self, zf: np.ndarray, zb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of a batch: input projections (time, batch, 3h) of either direction and the mask of real words."""
        p = self.p
        forth, sf = self._run(zf, mask, p["uf"], keep)
        back, sb = self._run(zb[::-1], mask[::-1], p["ub"], keep)
        states = np.concatenate([forth, back[::-1]], axis=2)
        hidden = np.tanh(states @ p["att"])
        e = np.where(mask, hidden @ p["v"], -1e9)
        weight = np.exp(e - e.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["out"] + p["b"][0]
        return (logit, states, hidden, weight, pooled, sf, sb) if keep else logit

    def gradients(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, sample_weight: np.ndarray):
        """Loss, gradients of all but the vectors, and of the inputs x (one per distinct word; rows index them; row 0 is
        the padding)."""
        p, h = self.p, STATE
        mask = (rows > 0).T
        zf, zb = (x @ p["wf"] + p["bf"])[rows.T], (x @ p["wb"] + p["bb"])[rows.T]
        logit, states, hidden, weight, pooled, sf, sb = self.forward(zf, zb, mask, keep=True)
        prob = _sigmoid(logit)
        total = sample_weight.sum()
        loss = float((sample_weight * (np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit))))).sum() / total)
        g = {}
        dlogit = (sample_weight * (prob - y) / total).astype(np.float32)
        g["out"], g["b"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["out"]
        dstates = weight[:, :, None] * dpooled
        dweight = (states * dpooled).sum(axis=2)
        de = weight * (dweight - (weight * dweight).sum(axis=0)) * mask
        dhidden = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["v"] = (hidden * de[:, :, None]).sum(axis=(0, 1))
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g["att"] = flat(states).T @ flat(dhidden)
        dstates = dstates + dhidden @ p["att"].T
        dx = np.zeros_like(x)
        for w, u, b, saved, ds, m, order in (("wf", "uf", "bf", sf, dstates[:, :, :h], mask, slice(None)), ("wb", "ub", "bb", sb, dstates[::-1, :, h:], mask[::-1], slice(None, None, -1))):
            dz, du, later = np.zeros((len(rows.T), len(rows), 3 * h), np.float32), np.zeros_like(p[u]), np.zeros((len(rows), h), np.float32)
            for t in range(len(saved) - 1, -1, -1):
                state, r, k, c, a = saved[t]
                on = m[t][:, None]
                d = ds[t] + later
                dn = np.where(on, d, 0)
                dc = dn * (1 - k) * (1 - c**2)
                dk = dn * (state - c) * k * (1 - k)
                dr = dc * a * r * (1 - r)
                da = np.concatenate([dr, dk, dc * r], axis=1)
                dz[t] = np.concatenate([dr, dk, dc], axis=1)
                du += state.T @ da
                later = np.where(on, dn * k + da @ p[u].T, d)
            dz = dz[order]
            flat_rows = rows.T.reshape(-1)
            per_word = _scatter(len(x), flat_rows, flat(dz))
            g[w], g[u], g[b] = x.T @ per_word, du, flat(dz).sum(axis=0)
            dx += per_word @ p[w].T
        return loss, g, dx


class Classifier:
    """A network with its vocabulary and memo; scores texts. A document counts as abusive from ``threshold`` on; ``held``
    are the documents held out, those reviewed as abusive, those found and both."""

    def __init__(self, network: Network, threshold: float = THRESHOLDS[-1], held: tuple[int, ...] = (0, 0, 0, 0)):
        self.network, self.threshold, self.held = network, threshold, held
        self._start()

    def _start(self) -> None:
        self.vocabulary = Vocabulary()
        self.zf = self.zb = np.zeros((0, 3 * STATE), np.float32)
        self.memo: dict[int, float] = {}

    def __getstate__(self) -> dict:
        return {"network": self.network, "threshold": self.threshold, "held": self.held}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _project(self) -> None:
        """Input projections of the words that are new since the last call."""
        v, old = self.vocabulary, len(self.zf)
        if len(v.word_bucket) > old:
            x = self.network.inputs(np.array(v.word_bucket[old:]), v.grams[old:])
            p = self.network.p
            self.zf = np.concatenate([self.zf, x @ p["wf"] + p["bf"]])
            self.zb = np.concatenate([self.zb, x @ p["wb"] + p["bb"]])

    def score_rows(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each window."""
        self._project()
        length = (rows > 0).sum(axis=1)
        order = np.argsort(length, kind="stable")
        out = np.zeros(len(rows), np.float32)
        for at in range(0, len(rows), SCORED):
            part = order[at : at + SCORED]
            steps = max(1, int(length[part[-1]]))
            r = rows[part, :steps].T
            out[part] = _sigmoid(self.network.forward(self.zf[r], self.zb[r], r > 0))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: of its worst window; 0 for texts without words."""
        if len(self.vocabulary.tokens) > MEMO_WORDS or len(self.memo) > MEMO_WINDOWS:
            self._start()
        windows = Windows(self.vocabulary, texts)
        rows = windows.rows
        key = _row_keys(rows)
        keys = key.tolist()
        known = [self.memo.get(k) for k in keys]
        fresh = np.array([k is None for k in known], bool)
        scores = np.array([0.0 if k is None else k for k in known], np.float32)
        if fresh.any():
            at = np.flatnonzero(fresh)
            _, one, back = np.unique(key[at], return_index=True, return_inverse=True)
            found = self.score_rows(rows[at[one]])
            scores[at] = found[back]
            self.memo.update(zip(key[at[one]].tolist(), found.tolist()))
        out = np.zeros(len(texts), np.float32)
        np.maximum.at(out, windows.text, scores)
        return out


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            self.p[k] -= rate * m / (np.sqrt(v) + 1e-7)


def train(network: Network, vocabulary: Vocabulary, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int, rng: np.random.Generator, rate: float = 0.01) -> float:
    """Adam steps on batches drawn by weight; returns the mean loss of the last steps."""
    adam, losses = _Adam(network.p, rate), []
    chance = weights / weights.sum()
    for step in range(steps):
        adam.rate = rate * (1 - 0.9 * step / steps)
        pick = rng.choice(len(rows), BATCH, p=chance)
        words, inverse = np.unique(np.r_[0, rows[pick].reshape(-1)], return_inverse=True)
        local = inverse[1:].reshape(len(pick), -1)
        local = local[:, : max(1, int((local > 0).sum(axis=1).max()))]
        buckets, grams = np.array([vocabulary.word_bucket[w] for w in words]), [vocabulary.grams[w] for w in words]
        x = network.inputs(buckets, grams)
        loss, g, dx = network.gradients(x, local, labels[pick].astype(np.float32), np.ones(len(pick), np.float32))
        sizes = np.array([len(a) for a in grams])
        g["word"] = _scatter(BUCKETS, buckets, dx[:, :WORD_DIM])
        g["char"] = _scatter(BUCKETS, np.concatenate(grams), np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
        if norm > 2:
            g = {k: d * (2 / norm) for k, d in g.items()}
        adam.step(g)
        losses.append(loss)
    return float(np.mean(losses[-20:]))


def evidence(rows: np.ndarray, of: np.ndarray, verdict: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, how much its words speak for abusive documents, and whether all of them are common.

    The first is the mean of its three largest log odds, less 1.5 standard errors, of being in a document reviewed as
    abusive against one that is not, where a word of a single such document says nothing; 0 where too few are so reviewed.
    """
    doc, word = np.divmod(np.unique(np.repeat(of, rows.shape[1]) * n_words + rows.reshape(-1)), n_words)
    doc, word = doc[word > 0], word[word > 0]
    yes = verdict[doc] > 0.5
    n_yes, n_no = (verdict > 0.5).sum(), (~(verdict > 0.5)).sum()
    there = np.bincount(word[yes], minlength=n_words)
    elsewhere = np.bincount(word[~yes], minlength=n_words)
    often = elsewhere >= max(3, COMMON * n_no)
    often[0] = True
    common = often[rows].all(axis=1)
    if n_yes < ENOUGH:
        return np.zeros(len(rows)), common
    odds = np.log((there + 0.5) / (n_yes + 1)) - np.log((elsewhere + 0.5) / (n_no + 1)) - 1.5 * np.sqrt(1 / (there + 0.5) + 1 / (elsewhere + 0.5))
    odds[there < 2] = np.minimum(odds[there < 2], 0)
    odds[0] = -9
    return np.sort(odds[rows], axis=1)[:, -3:].mean(axis=1), common


def fit(reviewed: list[tuple[str | None, float]], others: list[str | None], seeds: int = SEEDS, steps: int = STEPS, seed: int = 7) -> Classifier:
    """A classifier from reviewed texts (mean verdict 0 to 1), other texts and seed sentences.

    The reviews speak of whole documents, so the windows of an abusive one that carry the verdict have to be found: a first
    network is trained on the seeds against windows of the other texts; then, ``ROUNDS`` times, windows are labelled by verdict, present
    score and the odds of their words together, windows on which these disagree are left out, and training goes on. One of
    ``HELD`` reviewed texts is held out, for the threshold.
    """
    _one_thread()
    rng = np.random.default_rng(seed)
    network, vocabulary = Network(seed), Vocabulary()
    tool = Classifier(network)
    tool.vocabulary = vocabulary
    sentences, truth = seed_sentences(seeds, rng)
    seed_windows = Windows(vocabulary, sentences)
    seed_y = np.array(truth, np.float32)[seed_windows.text]
    held, reviewed = reviewed[::HELD], [r for k, r in enumerate(reviewed) if k % HELD]
    texts = [t for t, _ in reviewed] + list(others)
    verdict = np.r_[np.array([v for _, v in reviewed], np.float64), np.full(len(others), np.nan)]
    windows = Windows(vocabulary, texts)
    odds, common = evidence(windows.rows, windows.text, verdict, len(vocabulary.word_bucket))
    enough = (verdict > 0.5).sum() >= ENOUGH
    # Equal windows count once; of reviewed ones the reviewed copy. One that several harmless documents have is harmless.
    if len(windows.rows):
        _, one, same = np.unique(_row_keys(windows.rows), return_index=True, return_inverse=True)
        which, owner = np.divmod(np.unique(same.reshape(-1) * len(texts) + windows.text), len(texts))
        seen_no = np.bincount(which[verdict[owner] < 0.5], minlength=len(one))
        seen_yes = np.bincount(which[verdict[owner] > 0.5], minlength=len(one))
        common = common[one] | ((seen_no >= 2) & (seen_yes == 0))
    else:
        one = np.zeros(0, np.int64)
    rows, of, odds, across = windows.rows[one], windows.text[one], odds[one], windows.across[one]
    v = verdict[of]
    plain = np.flatnonzero((common | (v < 0.5)) & (odds < 1.0))
    both = np.concatenate([seed_windows.rows, rows[plain]])
    share = np.r_[np.full(len(seed_y), 0.6 / max(1, len(seed_y))), np.full(len(plain), 0.4 / max(1, len(plain)))]
    train(network, vocabulary, both, np.r_[seed_y, np.zeros(len(plain), np.float32)], share, steps // 3, rng)
    for _ in range(ROUNDS):
        if not len(rows):
            break
        tool.zf = tool.zb = np.zeros((0, 3 * STATE), np.float32)
        score = tool.score_rows(rows).astype(np.float64)
        told = (score > 0.5) & ~common
        worst = np.zeros(len(texts))
        np.maximum.at(worst, of[~across], score[~across])
        bad = ~across & np.where(np.isnan(v), (score > 0.95) & ~common & ((odds > 0) if enough else False), (v > 0.5) & (told | (odds > TELLING)))
        # A window over the end of a sentence is harmless where all the sentences of its document are and no review or word says else.
        calm = across & (worst[of] < 0.5) & ((v < 0.5) | (np.isnan(v) & (odds < 0)))
        good = (calm | common | np.where(np.isnan(v), score < 0.5, np.where(v < 0.5, (score < 0.9) | (odds < 0), score < 0.2))) & ((odds < 1.0) | calm) & ~bad
        use = np.flatnonzero(bad | good)
        y = bad[use].astype(np.float32)
        # Harmless windows that look worst are drawn more often.
        weight = np.where(y > 0, 0.2, (0.5 + 40 * score[use]))
        for mark, part in ((1, 0.2), (0, 0.5)):
            weight[y == mark] *= part / max(1e-9, weight[y == mark].sum())
        both = np.concatenate([seed_windows.rows, rows[use]])
        share = np.r_[np.full(len(seed_y), 0.3 / max(1, len(seed_y))), weight]
        train(network, vocabulary, both, np.r_[seed_y, y], share, 2 * steps // (3 * ROUNDS), rng, rate=0.006)
    return _with_threshold(Classifier(network), held)


def _with_threshold(tool: Classifier, held: list[tuple[str | None, float]]) -> Classifier:
    """The threshold with the best F1 on the held-out reviews; of equal ones the highest, as harmless documents are far
    more in number than the reviewed ones show."""
    score, said = tool.score([t for t, _ in held]), np.array([v > 0.5 for _, v in held], bool)
    tried = [(int((score >= t).sum()), int(((score >= t) & said).sum()), t) for t in THRESHOLDS]
    if said.sum() >= TELLING_HELD:
        found, both, tool.threshold = max(tried, key=lambda x: (2 * x[1] / max(1, x[0] + said.sum()), x[2]))
    else:
        found, both, tool.threshold = tried[-1]
    tool.held = (len(held), int(said.sum()), found, both)
    tool._start()
    return tool


def fit_on(documents: DataFrame, reviews: DataFrame) -> Classifier:
    """``fit`` on bounded samples: at most 1.5 times ``REVIEWED`` reviewed and ``OTHERS`` other documents.

    The reviewed documents are chosen from the reviews alone, so what meets the documents is a bounded list of ids, and no
    text is shuffled for it.
    """
    marks = reviews.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("verdict"))
    chosen = bounded_sample(marks, F.col("doc_id"), ["doc_id", "verdict"], REVIEWED)
    own = documents.sparkSession.createDataFrame(chosen, "doc_id bigint, verdict double")
    known = documents.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "verdict").limit(2 * REVIEWED).collect() if chosen else []
    others = bounded_sample(documents, F.col("doc_id"), ["text"], OTHERS, F.col("text").isNotNull())
    return fit(sorted(((t, v) for t, v in known), key=lambda x: (x[0] or "", x[1])), [t for (t,) in others])


def content_scores(documents: DataFrame, classifier: Classifier, threshold: float | None = None) -> DataFrame:
    """``doc_id, source, score, abusive``: one row per input row, repeated ones too.

    A null, empty or blank text has score 0. Texts are scored whole, in overlapping windows. The threshold is the
    classifier's unless given. Map only: no shuffle at any size.
    """
    threshold = classifier.threshold if threshold is None else threshold
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool: Classifier = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                score = tool.score(part["text"].tolist()).astype(np.float64)
                yield part[["doc_id", "source"]].assign(score=score, abusive=score >= threshold)

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, score double, abusive boolean")


def source_rates(scores: DataFrame) -> DataFrame:
    """``source, n_docs, n_abusive, rate``: a null source is a source of its own."""
    return scores.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("abusive").cast("bigint")).alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate")
    )
