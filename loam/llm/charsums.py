"""Character models of all tokens of a table: what they are made of is counted by Spark, the driver gets what can be asked.

A table is asked only for tokens with characters outside ASCII and for tokens with a question mark. So of the n-grams within
ASCII only those that occur in such tokens are needed, with the sums over all tokens that their probabilities take; the
rest, long codes above all, is counted where it adds to these sums and never leaves the executors. The scores of such tokens
are those that a model of all n-grams gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.charlm import CharModels, _codes, _find, _hashes
from loam.session import cut_lineage

#: Characters that a worker takes n-grams from at a time.
SLICE = 500_000
#: What follows a quotation that was taken out of a text begins a token of its own.
_AFTER_QUOTE = re.compile(r"[”“\"»'’](?=[.,;:!?)])")
_BLANKS = re.compile(r"[\x00-\x20]+")
_GRAMS = "n int, h bigint, context bigint, suffix bigint, kind int, w0 bigint, w1 bigint"
#: Bits of ``kind``: the context is needed, the n-gram itself is, it begins a word.
_CONTEXT, _KEPT, _INITIAL = 1, 2, 4


def _high(flat: np.ndarray, n: int) -> np.ndarray:
    """Whether the n characters up to each position have one outside ASCII."""
    seen = np.r_[np.zeros(n, np.int64), np.cumsum(flat > 0x7F)]
    return seen[n:] > seen[: len(flat)]


def _offsets(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return which, np.arange(len(which)) - starts[which]


def _slices(words: list[str]) -> Iterator[slice]:
    first = size = 0
    for k, w in enumerate(words):
        size += len(w) + 2
        if size >= SLICE:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(words):
        yield slice(first, len(words))


def _asked(words: list[str], order: int) -> Iterator[pd.DataFrame]:
    """The n-grams within ASCII of these tokens, of their parts between blanks of any kind, and of what follows quotations."""
    forms = dict.fromkeys(p for w in words for p in _BLANKS.split(w) if p)
    for w in list(forms):
        forms.update(dict.fromkeys(w[m.end() :] for m in _AFTER_QUOTE.finditer(w)))
    forms.update(dict.fromkeys(p for w in words for p in w.split()))
    forms = list(forms)
    for part in _slices(forms):
        flat, starts = _codes(forms[part])
        _, offset = _offsets(starts)
        for n in range(1, order + 1):
            h = np.unique(_hashes(flat, n)[(offset >= n - 1) & ~_high(flat, n)])
            yield pd.DataFrame({"n": np.full(len(h), n, np.int32), "h": h.view(np.int64)})


def asked_of(tokens: DataFrame, order: int) -> dict[int, np.ndarray]:
    """Per length the sorted hashes of the n-grams within ASCII that the tokens of a column ``token`` ask for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _asked(pdf["token"].tolist(), order)

    found = tokens.select("token").mapInPandas(run, "n int, h bigint").distinct().toArrow()
    n, h = (found[c].to_numpy() for c in ("n", "h"))
    return {k: np.sort(h[n == k].view(np.uint64)) for k in range(1, order + 1)}


def _grams(words: list[str], weights: np.ndarray, order: int, asked: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    flat, starts = _codes(words)
    which, offset = _offsets(starts)
    hashes = {n: _hashes(flat, n) for n in range(1, order + 1)}
    # By length of the window that ends at each position: whether its sums are needed.
    needed = {0: np.ones(len(flat), bool)}
    for n in range(1, order + 1):
        needed[n] = (offset >= n - 1) & (_high(flat, n) | _find(asked[n], hashes[n])[1])
    for n in range(1, order + 1):
        at = np.flatnonzero(offset >= max(n - 1, 1))
        if n > 2:  # an n-gram counts for its context, and once for its suffix, whose context is one shorter
            at = at[needed[n - 2][at - 1]]
        h, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        end = at[first]
        blank, ours = np.zeros(len(end), np.int64), needed[n - 1][end - 1]
        kind = _CONTEXT * ours + _KEPT * (needed[n][end] | (n == 1)) + _INITIAL * ((offset[end] == n - 1) & (n > 1))
        yield pd.DataFrame({
            "n": np.full(len(end), n, np.int32), "h": h.view(np.int64),
            "context": np.where(ours, hashes[n - 1][end - 1].view(np.int64), 0) if n > 1 else blank, "suffix": hashes[n - 1][end].view(np.int64) if n > 1 else blank,
            "kind": kind.astype(np.int32), **{f"w{k}": np.bincount(inverse, weights[which[at], k], len(h)).astype(np.int64) for k in (0, 1)},
        })


def sums_of(tokens: DataFrame, order: int, asked: Broadcast, proper: Callable[[str], bool]) -> DataFrame:
    """The needed n-grams of the proper ones of all tokens, with their numbers in either half (``token, n0, n1``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, rows = [], []
            for k, token in enumerate(pdf["token"].tolist()):
                for part in token.split():
                    if part.isascii() or proper(part):
                        words.append(part)
                        rows.append(k)
            weights = pdf[["n0", "n1"]].to_numpy(np.float64)[rows]
            for some in _slices(words):
                yield from _grams(words[some], weights[some], order, asked.value)

    found = tokens.where("n0 > 0 or n1 > 0").mapInPandas(run, _GRAMS)
    return found.groupBy("n", "h", "context", "suffix", "kind").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def less(sums: DataFrame, removed: DataFrame) -> DataFrame:
    """The sums without those of removed tokens."""
    both = sums.unionByName(removed.withColumns({"w0": -F.col("w0"), "w1": -F.col("w1")}))
    return both.groupBy("n", "h", "context", "suffix", "kind").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def models_of(sums: DataFrame, order: int, label: str = "clean") -> list[CharModels]:
    """The models of the first half, of the second, and of both."""
    seen = {"0": F.col("w0") > 0, "1": F.col("w1") > 0, "2": (F.col("w0") > 0) | (F.col("w1") > 0)}
    live = sums.where(seen["2"])
    own = live.where(F.col("kind").bitwiseAND(_CONTEXT) > 0).select("n", "h", "context", "suffix", "kind", "w0", "w1", *[F.lit(0).cast("bigint").alias(f"l{v}") for v in seen])
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("context", "bigint"), ("suffix", "bigint"), ("kind", "int"), ("w0", "bigint"), ("w1", "bigint"))}
    longer = live.where("n > 1").select((F.col("n") - 1).cast("int").alias("n"), F.col("suffix").alias("h"), *none.values(), *[c.cast("bigint").alias(f"l{v}") for v, c in seen.items()])
    both = own.unionByName(longer).groupBy("n", "h").agg(
        *[F.max(c).alias(c) for c in ("context", "suffix", "kind")], *[F.sum(c).alias(c) for c in ("w0", "w1", "l0", "l1", "l2")]
    ).where("kind is not null")  # else only longer ones
    raw = (F.col("n") == order) | (F.col("kind").bitwiseAND(_INITIAL) > 0)
    of = lambda v, w: F.when(~seen[v], 0).when(raw, w).otherwise(F.greatest(F.col(f"l{v}"), F.lit(1))).alias(f"c{v}")
    counted = cut_lineage(both.select("n", "h", "context", "suffix", "kind", of("0", F.col("w0")), of("1", F.col("w1")), of("2", F.col("w0") + F.col("w1"))))
    kept = counted.where(F.col("kind").bitwiseAND(_KEPT) > 0).drop("kind").toArrow()
    contexts = counted.where("n > 1").groupBy("n", "context").agg(
        *[F.sum(f"c{v}").alias(f"mass{v}") for v in seen], *[F.sum((F.col(f"c{v}") > 0).cast("bigint")).alias(f"kinds{v}") for v in seen]
    ).toArrow()
    return [_model(kept, contexts, v, order, label) for v in seen]


def _model(kept: pa.Table, contexts: pa.Table, v: str, order: int, label: str) -> CharModels:
    column = lambda t, name: t[name].to_numpy()
    grams, sums = {}, {}
    for n in range(1, order + 1):
        here = np.flatnonzero((column(kept, "n") == n) & (column(kept, f"c{v}") > 0))
        h, context, suffix = (column(kept, c)[here].view(np.uint64) for c in ("h", "context", "suffix"))
        by = np.argsort(h)
        grams[n] = h[by], context[by], suffix[by], column(kept, f"c{v}")[here][by].astype(np.float64)
        here = np.flatnonzero((column(contexts, "n") == n) & (column(contexts, f"kinds{v}") > 0))
        h = column(contexts, "context")[here].view(np.uint64)
        by = np.argsort(h)
        sums[n] = h[by], column(contexts, f"mass{v}")[here][by].astype(np.float64), column(contexts, f"kinds{v}")[here][by].astype(np.float64)
    return CharModels.of_sums(label, grams, sums)
