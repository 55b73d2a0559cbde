"""Problem 7: the corpus encoded by a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern; each pre-token is merged over a segment tree of byte
positions whose root names the leftmost pair of lowest rank, so a merge costs a logarithmic number of updates and a
run of n bytes O(n log n) instead of O(n^2). Workers remember the pre-tokens they have met (a bounded memo).
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loam.session import spread

#: The folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Entries a worker's memo may hold before it starts afresh, and the longest pre-token it keeps.
MEMO, MEMO_CHARS = 200_000, 48
NONE = 1 << 30

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Byte sequences and ranks of a vocabulary in the public rank format (base64, blank, rank a line)."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        raise ValueError(f"{name}: no rank file in {folder}; only byte-level vocabularies can be used")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the leftmost pair of lowest rank is merged until none is left."""
    n = len(data)
    if n == 0:
        return []
    if n == 1:
        return [ranks[data]]
    get = ranks.get
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(data[i : i + 2], NONE)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = width + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < NONE:
        k = 1
        while k < width:
            k *= 2
            if tree[k] > tree[k + 1]:
                k += 1
        i = k - width
        j = after[i]
        end = after[j]
        after[i] = end
        put(j, NONE)
        if end < n:
            before[end] = i
            put(i, get(data[i : after[end]], NONE))
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, get(data[h:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : after[i]]])
        i = after[i]
    return out


def encoder(name: str, folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    """A function from text to ids, with its own bounded memo."""
    ranks, split, memo = load_ranks(name, folder), regex.compile(PATTERN).findall, {}

    def fill(piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        ids = (ranks[data],) if data in ranks else tuple(merge_bytes(data, ranks))
        if len(piece) <= MEMO_CHARS:
            if len(memo) >= MEMO:
                memo.clear()
            memo[piece] = ids
        return ids

    def encode(text: str) -> list[int]:
        out: list[int] = []
        extend, get = out.extend, memo.get
        for piece in split(text):
            extend(get(piece) or fill(piece))
        return out

    return encode


def _texts(batch: pa.RecordBatch, column: str) -> Iterable[str]:
    return (x or "" for x in batch.column(column).to_pylist())


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col, ids ARRAY<INT>``: the ids of each row's text, without special tokens.

    An empty and a null text give an empty list; the strings of special tokens are ordinary text. Each input row gives
    one row, repeated ones too. Only the two named columns are read. Map only: no shuffle at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [encode(x) for x in _texts(part, text_col)]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def have_vocabularies(folder: str = TOKENIZERS) -> bool:
    return importlib.util.find_spec("regex") is not None and os.path.isdir(folder)
