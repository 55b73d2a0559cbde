"""Problem 1: chunks over their file type's limit, cut at natural boundaries with overlap.

A text's token lengths are summed up once; the sums after a paragraph, a sentence or line, or any token are sorted
arrays of boundaries. Each piece ends at the last boundary of the best rank within reach (binary search), the next one
starts at a boundary a step of the overlap back, and only a run without any boundary is cut hard, never inside a
character with its combining marks.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A boundary of a higher rank is taken only where the piece is at least this full; else the next rank is tried.
FULL = 0.5
#: Tables of limits are read to the driver; they may not be longer than this.
MAX_LIMITS = 10_000

_TOKEN = re.compile(r"\s*\S+|\s+$")
_SENTENCE_END = re.compile(r"[.!?…。！？؟:;]['\"»”’)\]]*$")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which a piece may end, best rank first: paragraphs, sentences or lines, tokens.

    A token is a word with the white space before it, so an offset lies between a word's last character and the white
    space after it, which the next piece begins with.
    """
    tokens = _TOKEN.findall(text)
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, np.int64)
    paragraph, sentence = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    for i in range(len(tokens) - 1):
        gap = tokens[i + 1]
        lines = gap[: len(gap) - len(gap.lstrip())].replace("\r\n", "\n").replace("\r", "\n").count("\n")
        paragraph[i] = lines > 1
        sentence[i] = lines > 0 or _SENTENCE_END.search(tokens[i]) is not None
    return [ends[paragraph], ends[paragraph | sentence], ends]


def _hard(text: str, at: int, low: int) -> int:
    """A cut at or before ``at`` but after ``low`` that splits no character from its combining marks or joiners."""
    k = at
    while low < k < len(text) and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k if k > low else at


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the pieces: each at most ``limit`` long, together the whole text, the next starting before the last's
    end by ``overlap`` or a little more, as far as a boundary is there; less where the overlap leaves no room to go on.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    ranks = boundaries(text)
    overlap = max(0, min(overlap, limit // 2))

    def last(array: np.ndarray, low: int, high: int) -> int:
        """The last boundary in (low, high], or -1."""
        k = int(np.searchsorted(array, high, "right")) - 1
        return int(array[k]) if k >= 0 and array[k] > low else -1

    out, start, done = [], 0, 0
    while True:
        if len(text) - start <= limit:
            out.append((start, len(text)))
            return out
        top = start + limit
        end = -1
        for array in ranks:
            end = last(array, max(done, start + max(overlap, int(limit * FULL))), top)
            if end > 0:
                break
        low = max(done, start + overlap)
        if end < 0 and (end := last(ranks[2], low, top)) < 0:
            end = _hard(text, top, low)
        out.append((start, end))
        done = end
        goal = end - overlap
        nxt = end
        if overlap:
            floor = max(start, goal - overlap // 2)
            nxt = last(ranks[1], floor, goal)
            if nxt < 0 and (nxt := last(ranks[2], floor, goal)) < 0:
                nxt = _hard(text, goal, start)
        start = nxt if nxt > start else end


def split_oversized(chunks: DataFrame, limits: DataFrame, keep_whole: bool = False) -> DataFrame:
    """``chunk_id, piece_no, n_pieces, location, start, text``: the pieces of the chunks over their limit.

    ``limits`` gives ``max_chars`` and ``overlap_chars`` (code points) by ``file_type``; of a type listed twice the
    smallest limit holds, a null or negative overlap is none, one over half the limit counts as half of it (so that pieces
    move on), a limit below 1 or null is no limit. A chunk whose type is
    null or not listed, and a null or empty text, is never over the limit. With ``keep_whole`` the other chunks come as
    one piece with their own location. The location of a piece is the chunk's with ``part i/n`` after it. A chunk_id that
    is repeated with the same text counts once; with different texts each is split. Only rows over the limit, found by
    a length test inside the JVM, are shuffled for that and reach Python.
    """
    rows = limits.select("file_type", F.col("max_chars").cast("bigint"), F.col("overlap_chars").cast("bigint")).limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    best: dict[str, tuple[int, int]] = {}
    for kind, most, overlap in rows:
        if kind is not None and most is not None and most > 0:
            best[kind] = min(best.get(kind, (1 << 62, 0)), (most, max(0, overlap or 0)))
    pairs = [F.lit(x) for kind, (most, _) in sorted(best.items()) for x in (kind, most)]
    most = F.create_map(*pairs)[F.col("file_type")] if pairs else F.lit(None).cast("bigint")
    base = chunks.select("chunk_id", "file_type", "location", "text")
    over = F.coalesce(F.length("text") > most, F.lit(False))

    def cut(batches):
        for pdf in batches:
            out = []
            for chunk, kind, location, text in pdf[["chunk_id", "file_type", "location", "text"]].itertuples(index=False):
                parts = spans(text, *best[kind])
                for i, (a, b) in enumerate(parts, 1):
                    out.append((chunk, i, len(parts), f"{location or ''} part {i}/{len(parts)}".strip(), a, text[a:b]))
            yield pd.DataFrame(out, columns=["chunk_id", "piece_no", "n_pieces", "location", "start", "text"])

    schema = "chunk_id bigint, piece_no int, n_pieces int, location string, start bigint, text string"
    pieces = base.where(over).dropDuplicates(["chunk_id", "text"]).mapInPandas(cut, schema)
    if not keep_whole:
        return pieces
    whole = base.where(~over).select(
        "chunk_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), "location", F.lit(0).cast("bigint").alias("start"), "text"
    )
    return pieces.unionByName(whole.distinct())
