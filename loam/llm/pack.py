"""Problem 8: texts into containers of fixed token capacity, best fit decreasing.

Sizes come from the tokenizer the container kind names. Only a text that alone exceeds the capacity is cut, at token
boundaries that are character boundaries as well, into full pieces and a rest. The items are hashed into groups of a
bounded number of items; a group is packed by one task, best fit decreasing, the tightest open container being found by
a segment tree over remaining capacities. Containers never mix groups, which costs less than one container a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import TOKENIZERS, encoder, load_ranks
from loam.session import spread

#: Items a group holds on average; bounds a packing task's memory and the loss at group ends alike.
GROUP_ITEMS = 50_000
#: Container kinds a table may list (they are read to the driver).
MAX_KINDS = 1_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item. Larger items first, ties in given order; the fullest container that still fits.

    The tree's leaves are remaining capacities 0..capacity, each with a stack of open containers; a node counts its
    containers, so the least sufficient capacity is found in logarithmic time.
    """
    width = 1 << int(capacity).bit_length()
    count = [0] * (2 * width)
    stacks: dict[int, list[int]] = {}
    bins = np.zeros(len(sizes), np.int64)
    opened = 0

    def change(left: int, by: int) -> None:
        k = width + left
        while k:
            count[k] += by
            k >>= 1

    def least(need: int) -> int:
        """The least remaining capacity >= need that a container has, or -1."""
        k = width + need
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < width:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - width
            k >>= 1
        return -1

    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        left = least(size)
        if left < 0:
            b, left = opened, capacity
            opened += 1
        else:
            b = stacks[left].pop()
            change(left, -1)
        bins[i] = b
        stacks.setdefault(left - size, []).append(b)
        change(left - size, 1)
    return bins


def cuts(ids: list[int], capacity: int, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Token ranges of at most ``capacity``; a range ends before a token that begins a character where one is near."""
    n, out, at = len(ids), [], 0
    while n - at > capacity:
        end = at + capacity
        while end > at + capacity // 2 and not firsts[ids[end]]:
            end -= 1
        out.append((at, end if firsts[ids[end]] else at + capacity))
        at = out[-1][1]
    out.append((at, n))
    return out


def pack(df: DataFrame, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``container_kind, container_id, <id_col>, piece_no, token_start, n_tokens``: each text once per container kind.

    A null or empty text is an item of no tokens and lies in some container of its group. Each row of the input is an
    item; ``container_id`` is unique within a kind. Kinds with a null name, capacity or tokenizer, or a capacity below
    1, are left out; a kind listed twice counts once. An empty input gives no rows. The shuffle carries three numbers
    an item, never a text.
    """
    kinds = sorted({tuple(r) for r in sizes.select("container_kind", "tokenizer", F.col("capacity_tokens").cast("bigint")).distinct().limit(MAX_KINDS + 1).collect() if None not in tuple(r) and r[2] > 0})
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    by_tokenizer: dict[str, list[tuple[int, int]]] = {}
    for k, (_, tokenizer, capacity) in enumerate(kinds):
        by_tokenizer.setdefault(tokenizer, []).append((k, capacity))
    kind_type = df.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for tokenizer, wanted in by_tokenizer.items():
            ranks = load_ranks(tokenizer, folder)
            firsts = np.zeros(max(ranks.values()) + 1, bool)
            for data, rank in ranks.items():
                firsts[rank] = data[0] & 0xC0 != 0x80
            tools.append((encoder(tokenizer, folder), firsts, wanted))
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                for encode, firsts, wanted in tools:
                    ids = encode(text or "")
                    for k, capacity in wanted:
                        for piece, (a, b) in enumerate(cuts(ids, capacity, firsts)):
                            rows.append(i)
                            out.append((k, piece, a, b - a))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(numbers[:, c].astype(np.int32)) for c in range(4))], [id_col, "kind", "piece_no", "token_start", "n_tokens"]
            )

    items = spread(df.select(id_col, text_col)).mapInArrow(measure, f"`{id_col}` {kind_type}, kind int, piece_no int, token_start int, n_tokens int")
    groups = max(1, -(-df.count() // group_items))
    names, capacities = [k[0] for k in kinds], [k[2] for k in kinds]

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group = key
        pdf = pdf.sort_values([id_col, "piece_no"], kind="stable")
        bins = best_fit_decreasing(pdf["n_tokens"].to_numpy(np.int64), capacities[kind])
        return pdf[[id_col, "piece_no", "token_start", "n_tokens"]].assign(container_kind=names[kind], container_id=bins * groups + group)

    salted = items.withColumn("group", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(groups)).cast("int"))
    schema = f"container_kind string, container_id bigint, `{id_col}` {kind_type}, piece_no int, token_start int, n_tokens int"
    return salted.groupBy("kind", "group").applyInPandas(
        lambda key, pdf: place(key, pdf)[["container_kind", "container_id", id_col, "piece_no", "token_start", "n_tokens"]], schema
    )
